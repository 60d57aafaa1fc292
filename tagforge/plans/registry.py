"""Queries by name and their DuckDB twins."""

from tagforge.plans import oracle, queries

QUERIES = {
    "q01_track_best": queries.q01, "q02_frame_tracks": queries.q02, "q03_bbox": queries.q03, "q04_raw_text": queries.q04, "q05_first_price": queries.q05,
    "q06_zones": queries.q06, "q07_discount": queries.q07, "q08_price_rules": queries.q08, "q09_code_fields": queries.q09, "q10_code_fallback": queries.q10,
    "q11_tag_color": queries.q11, "q12_orientation": queries.q12, "q13_sharpness": queries.q13, "q14_frame_sampler": queries.q14, "q15_similarity": queries.q15,
    "q16_progress": queries.q16, "q17_record": queries.q17, "q18_display": queries.q18, "q19_thumbnails": queries.q19,
    "q20_keyframes": queries.q20, "q21_fields": queries.q21, "q22_labelled": queries.q22, "q23_names": queries.q23, "q24_ocr_lines": queries.q24,
    "q25_evaluation": queries.q25, "q26_crops": queries.q26, "q27_price_tags": queries.q27, "q28_numbered": queries.q28, "q29_shrunk": queries.q29, "q30_average_precision": queries.q30,
}
ORACLE_SQL = oracle.SQL
