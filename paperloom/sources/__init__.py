"""Readers: tables, workbooks, files and JSON fixtures."""
