"""The catalog that a new system starts with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.imports import FIELDS, HEADERS

# Codes, names and descriptions of the document types.
TYPES = (
    ("PLAN", "Kế hoạch", "Kế hoạch triển khai nhiệm vụ và hoạt động."),
    ("PROGRAM", "Chương trình", "Chương trình tổ chức hội nghị, sự kiện và hoạt động."),
    ("REPORT", "Báo cáo", "Báo cáo tình hình và kết quả thực hiện nhiệm vụ."),
    ("RESOLUTION", "Nghị quyết", "Nghị quyết của tập thể hoặc hội nghị."),
    ("CONCLUSION_NOTICE", "Thông báo kết luận", "Thông báo kết luận và phân công sau cuộc họp."),
    ("DECISION", "Quyết định", "Quyết định quản lý và tổ chức thực hiện."),
    ("INVITATION", "Giấy mời", "Giấy mời tham dự cuộc họp hoặc sự kiện."),
)
# What every template begins and ends with, and the body of each type's basic one.
HEADER = """TÊN CƠ QUAN
Số: .../...

CỘNG HÒA XÃ HỘI CHỦ NGHĨA VIỆT NAM
Độc lập - Tự do - Hạnh phúc

..., ngày ... tháng ... năm ..."""
FOOTER = """Nơi nhận:
- ...;
- Lưu: VT.

ĐẠI DIỆN CƠ QUAN
(Ký, ghi rõ họ tên)"""
BODIES = {
    "PLAN": """KẾ HOẠCH
...

I. MỤC ĐÍCH, YÊU CẦU
...

II. NỘI DUNG
...

III. TIẾN ĐỘ THỰC HIỆN
...

IV. TỔ CHỨC THỰC HIỆN
...""",
    "PROGRAM": """CHƯƠNG TRÌNH
...

I. MỤC ĐÍCH, YÊU CẦU
...

II. THỜI GIAN, ĐỊA ĐIỂM
...

III. THÀNH PHẦN
...

IV. NỘI DUNG CHƯƠNG TRÌNH
...

V. TỔ CHỨC THỰC HIỆN
...""",
    "REPORT": """BÁO CÁO
...

I. TÌNH HÌNH CHUNG
...

II. KẾT QUẢ THỰC HIỆN
...

III. HẠN CHẾ, NGUYÊN NHÂN
...

IV. NHIỆM VỤ, GIẢI PHÁP THỜI GIAN TỚI
...""",
    "RESOLUTION": """NGHỊ QUYẾT
...

Căn cứ ...;
Sau khi thảo luận và thống nhất,

QUYẾT NGHỊ:

Điều 1. ...

Điều 2. ...

Điều 3. ...""",
    "CONCLUSION_NOTICE": """THÔNG BÁO KẾT LUẬN
...

Ngày ..., ... đã chủ trì cuộc họp về ...
Sau khi nghe báo cáo và các ý kiến, kết luận như sau:

1. Kết luận
...

2. Phân công thực hiện
...

3. Thời hạn hoàn thành
...""",
    "DECISION": """QUYẾT ĐỊNH
...

Căn cứ ...;
Theo đề nghị của ...,

QUYẾT ĐỊNH:

Điều 1. ...

Điều 2. ...

Điều 3. ...""",
    "INVITATION": """GIẤY MỜI
...

Kính mời: ...

Thời gian: ...

Địa điểm: ...

Nội dung: ...

Đề nghị đại biểu tham dự đầy đủ, đúng giờ.""",
}
FORMAT_RULES = (
    '{"version": 1, "rules": [{"code": "national_header", "required": true}, '
    '{"code": "reference_number", "required": true}, {"code": "signature_block", "required": true}]}'
)


def definitions(spark: SparkSession) -> DataFrame:
    """A type and a basic template each: (code, name, description, template_name, template_content, format_rules)."""
    rows = [(code, name, about, f"Mẫu {name.lower()} cơ bản", "\n\n".join((HEADER, BODIES[code], FOOTER)), FORMAT_RULES) for code, name, about in TYPES]
    return spark.createDataFrame(rows, "code string, name string, description string, template_name string, template_content string, format_rules string")


def import_headers(spark: SparkSession) -> DataFrame:
    """(position, header, field) of the member workbook."""
    return spark.createDataFrame([(i + 1, h, f) for i, (h, f) in enumerate(zip(HEADERS, FIELDS, strict=True))], "position int, header string, field string")
