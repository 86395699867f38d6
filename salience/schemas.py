"""Schemas of the stored tables, as DDL text where readers take it."""

DOCUMENT = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"
PAIR = "doc_id LONG, document STRING, summary STRING"
ENTITY = (
    "STRUCT<text: STRING, start_idx: BIGINT, end_idx: BIGINT, ent_type: STRING, "
    "tokens: ARRAY<STRING>, i: ARRAY<BIGINT>>"
)
ENTITIES = f"ARRAY<{ENTITY}>"
TOKEN = (
    "STRUCT<text: STRING, i: BIGINT, idx: BIGINT, dep: STRING, head: BIGINT, children: ARRAY<BIGINT>, "
    "iob: STRING, ent_type: STRING, whitespace: STRING>"
)
TOKENS = f"ARRAY<{TOKEN}>"
SCORES = "doc_id LONG, dataset STRING, checkpoint STRING, system STRING, metric STRING, score DOUBLE"
JUDGEMENT = (
    "dataset STRING, checkpoint STRING, doc_id LONG, a_first BOOLEAN, raw_result STRING, winner STRING, feedback STRING"
)
VOTES = "item LONG, annotator STRING, dimension STRING, vote STRING"
ANSWER_KEY = "item LONG, grp LONG, dataset STRING, row LONG, system_a STRING, system_b STRING"
TESTS = "dataset STRING, metric STRING, checkpoint STRING, p_raw DOUBLE, direction STRING"
