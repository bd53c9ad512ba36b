"""Schemas of the datasets; nothing is inferred."""

from __future__ import annotations

HEADINGS = "array<struct<level:int,text:string>>"
BYLINES = "array<struct<raw:string>>"

#: source_file and section are a section's place: sections follow each other in this order.
SECTION = (
    f"juan_num int, juan_label string, file_name string, source string, headings {HEADINGS}, paragraphs array<string>, "
    f"paragraphs_raw array<string>, paragraphs_byline {BYLINES}, raw_concat string, source_file string, section long"
)
PUNCTUATED = (
    f"juan_num int, juan_label string, file_name string, headings {HEADINGS}, paragraphs_plain array<string>, "
    f"paragraphs_punctuated array<string>, paragraphs_provenance array<string>, paragraphs_byline {BYLINES}, fallback_span_count int, matched boolean, "
    "source_file string, section long"
)
OPCODES = "array<struct<tag:string,i1:int,i2:int,j1:int,j2:int>>"
SENTENCE = (
    f"sentence_id string, juan_num int, juan_label string, headings {HEADINGS}, paragraph_idx int, sentence_idx int, utterance_id string, "
    "text_punctuated string, text_plain string, char_count int, byline struct<raw:string>"
)
LETTER = (
    "data_id string, munjip string, kwon int, seq int, title string, annotation string, inferred_year int, raw_text string, plain_text string, "
    "char_count_raw int, char_count_plain int, body_first_50 string, sender_label string, target_name string, source_zip string, source_xml_path string, fetched_at string"
)
LETTER_SENTENCE = (
    "sentence_id string, letter_data_id string, munjip string, kwon int, letter_seq int, letter_title string, letter_year int, sender_label string, target_name string, "
    "para_idx int, sent_idx_in_para int, sent_idx_in_letter int, sent_text string, sent_text_plain string, char_count_raw int, char_count_plain int"
)
TARGET = "target_name string, munjip string, kwon array<int>, title_pattern string, label string, description string"
PREDICTIONS = "text string, preds array<struct<end:int,entity:string>>"
