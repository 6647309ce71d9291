"""Training-data operators: mixing, media, chat, scans, deduplication, decontamination and quality."""
