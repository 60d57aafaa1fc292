"""The flat output record of a tag, its display form, and thumbnails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagforge.functions import geometry, text
from tagforge.operators.fields import joined, parse_fields

# The output columns in order, and those that hold prices.
COLUMNS = [
    "filename", "product_name", "price_default", "price_card", "price_discount", "barcode", "discount_amount",
    "id_sku", "print_datetime", "code", "additional_info", "color", "special_symbols", "frame_timestamp",
    "x_min", "y_min", "x_max", "y_max", "warped_image", "raw_text", *text.CODE_KEYS,
]
PRICES = ["price_default", "price_card", "price_discount", "price1_qr", "price2_qr", "price3_qr", "price4_qr", "wholesale_level_1_price", "wholesale_level_2_price", "action_price_qr"]
# Columns shown, in order, after the thumbnail.
SHOWN = [
    "product_name", "price_default", "price_card", "price_discount", "discount_amount", "barcode", "id_sku", "print_datetime", "code", "additional_info",
    "color", "special_symbols", "frame_timestamp", "raw_text", *text.CODE_KEYS, "x_min", "y_min", "x_max", "y_max",
]

# What the shown columns are called, the thumbnail first, and the names of colors.
LABELS = {
    "thumbnail": "Фото", "product_name": "Название", "price_default": "Цена", "price_card": "Цена по карте", "price_discount": "Цена со скидкой", "discount_amount": "Скидка",
    "barcode": "QR-сырые данные", "id_sku": "SKU", "print_datetime": "Дата печати", "code": "Код", "additional_info": "Доп. информация", "color": "Цвет", "special_symbols": "Символы",
    "frame_timestamp": "Кадр", "raw_text": "Исходный текст OCR", "qr_code_barcode": "Штрихкод из QR", "price1_qr": "Цена 1 (QR)", "price2_qr": "Цена 2 (QR)", "price3_qr": "Цена 3 (QR)",
    "price4_qr": "Цена 4 (QR)", "wholesale_level_1_count": "Опт 1, кол-во", "wholesale_level_1_price": "Опт 1, цена", "wholesale_level_2_count": "Опт 2, кол-во",
    "wholesale_level_2_price": "Опт 2, цена", "action_price_qr": "Акц. цена (QR)", "action_code_qr": "Код акции (QR)", "x_min": "X min", "y_min": "Y min", "x_max": "X max", "y_max": "Y max",
}
COLOR_NAMES = {"red": "красный", "yellow": "жёлтый"}
OTHER_COLOR = "неизвестно"


def explode_tags(frames: DataFrame, *more: str) -> DataFrame:
    """frames: video, timestamp_ms, price_tags -> one row a tag, with more columns of its frame; a frame without tags gives none."""
    return frames.select("video", "timestamp_ms", *more, F.posexplode("price_tags").alias("tag_ord", "tag")).select("video", "timestamp_ms", *more, "tag_ord", "tag.*")


def complete(rows: DataFrame, columns: list[str] = COLUMNS) -> DataFrame:
    """The columns in order; missing ones are '', others are dropped."""
    return rows.select(*(F.col(c) if c in rows.columns else F.lit("").alias(c) for c in columns))


def with_formatted_prices(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.when(F.col(c) != "", text.format_price(F.col(c))).otherwise(F.col(c)) for c in PRICES if c in rows.columns})


def records(tags: DataFrame, assume_99: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """tags: video, timestamp_ms, corners, color, qr_data, qr_bbox, ocr_text, warp_w, warp_h and perhaps
    warped_image -> the 31 columns and those to keep.  A null color is unknown; null lines are none."""
    lines = F.coalesce("ocr_text", F.array().cast(tags.schema["ocr_text"].dataType))
    color = F.coalesce("color", F.lit("unknown"))
    width, height = F.coalesce("warp_w", F.lit(0)), F.coalesce("warp_h", F.lit(0))
    rows = tags.withColumns({
        "filename": text.base_name(F.col("video")),
        "fields": parse_fields(lines, F.col("qr_bbox"), color, width, height, assume_99),
        "codes": text.parse_code(F.col("qr_data")),
        "box": geometry.bounding_box(F.col("corners")),
        "raw_text": joined(lines),
        "barcode": text.text_of(F.col("qr_data")),
        "frame_timestamp": F.col("timestamp_ms"),
        "color": color,
    })
    kept = [c for c in rows.columns if c in COLUMNS or c in keep]
    return with_formatted_prices(complete(rows.select(*kept, "fields.*", "codes.*", "box.*"), [*COLUMNS, *keep]))


def display(rows: DataFrame, *more: str) -> DataFrame:
    """Shown columns as text with `-` for what is missing; prices with a decimal comma; more columns as they are."""
    shown = lambda c: text.format_price(F.col(c)) if c in PRICES else F.col(c)
    return rows.select(*more, *(text.placeholder(shown(c)).alias(c) for c in SHOWN))


def color_name(color: F.Column) -> F.Column:
    out = F.lit(OTHER_COLOR)
    for key, name in COLOR_NAMES.items():
        out = F.when(color == key, name).otherwise(out)
    return out


def labelled(rows: DataFrame) -> DataFrame:
    """Shown columns under their labels, colors by name, the thumbnail (`-` without one) first."""
    shown = display(rows, *(["thumbnail"] if "thumbnail" in rows.columns else []))
    picture = text.placeholder(F.col("thumbnail")) if "thumbnail" in rows.columns else F.lit("-")
    columns = {c: F.col(c) for c in SHOWN} | {"thumbnail": picture, "color": color_name(F.col("color"))}
    return shown.select(*(columns[c].alias(name) for c, name in LABELS.items()))


def with_thumbnails(rows: DataFrame, images: DataFrame) -> DataFrame:
    """rows ⟕ images (path, content) on warped_image, with the column thumbnail first; '' without an image."""
    uri = text.data_uri(F.col("content")).alias("thumbnail")
    return rows.join(images.select(F.col("path").alias("warped_image"), "content"), "warped_image", "left").select(uri, *rows.columns)
