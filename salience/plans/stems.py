"""Stems as SQL: the suffix rules over a table of distinct tokens, one nested select per step.

``w`` is the token, ``x`` what the steps so far have made of it, ``s`` its letters as c (consonant) and v (vowel). The
shape of a beginning of a word is the beginning of its shape.
"""

from __future__ import annotations

from salience.functions.stemming import IRREGULAR, SHORTEST_STEMMED, STEP_2, STEP_3, STEP_4

SHAPE = """list_reduce(list_prepend('', string_split(x, '')), lambda s, c: s || CASE
  WHEN c IN ('a', 'e', 'i', 'o', 'u') OR (c = 'y' AND right(s, 1) = 'c') THEN 'v' ELSE 'c' END)"""


def but(n: int, of: str = "x") -> str:
    return f"left({of}, length({of}) - {n})"


def measure(shape: str) -> str:
    return f"len(regexp_extract_all({shape}, 'v+c+'))"


def closed(word: str, shape: str) -> str:
    return f"(ends_with({shape}, 'cvc') AND right({word}, 1) NOT IN ('w', 'x', 'y'))"


def mended(word: str, shape: str) -> str:
    """What is left of a word after -ed or -ing, with its e back or its double letter single."""
    return f"""CASE WHEN regexp_matches({word}, '(at|bl|iz)$') THEN {word} || 'e'
      WHEN length({word}) > 1 AND right({word}, 1) = left(right({word}, 2), 1) AND right({shape}, 1) = 'c' AND right({word}, 1) NOT IN ('l', 's', 'z') THEN {but(1, word)}
      WHEN {measure(shape)} = 1 AND {closed(word, shape)} THEN {word} || 'e' ELSE {word} END"""


def swapped(table: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(
        f"WHEN ends_with(x, '{old}') THEN CASE WHEN {measure(but(len(old), 's'))} > 0 THEN {but(len(old))} || '{new}' ELSE x END" for old, new in table) + " ELSE x END"


def cut() -> str:
    def case(end: str) -> str:
        more = " AND regexp_matches(x, '[st]ion$')" if end == "ion" else ""
        return f"WHEN ends_with(x, '{end}') THEN CASE WHEN {measure(but(len(end), 's'))} > 1{more} THEN {but(len(end))} ELSE x END"

    return "CASE " + " ".join(map(case, STEP_4)) + " ELSE x END"


def short(ending: str) -> str:
    return f"WHEN ends_with(x, '{ending}') THEN CASE WHEN length(x) = 4 THEN {but(1)} ELSE {but(2)} END"


STEPS = [
    f"CASE {short('ies')} WHEN ends_with(x, 'sses') THEN {but(2)} WHEN ends_with(x, 's') AND NOT ends_with(x, 'ss') THEN {but(1)} ELSE x END",
    f"""CASE {short('ied')} WHEN ends_with(x, 'eed') THEN CASE WHEN {measure(but(3, 's'))} > 0 THEN {but(1)} ELSE x END
      WHEN ends_with(x, 'ed') AND contains({but(2, 's')}, 'v') THEN {mended(but(2), but(2, 's'))}
      WHEN ends_with(x, 'ing') AND contains({but(3, 's')}, 'v') THEN {mended(but(3), but(3, 's'))} ELSE x END""",
    f"CASE WHEN ends_with(x, 'y') AND length(x) > 2 AND substr(s, length(x) - 1, 1) = 'c' THEN {but(1)} || 'i' ELSE x END",
    swapped(STEP_2),
    swapped(STEP_3),
    cut(),
    f"""CASE WHEN ends_with(x, 'e') AND ({measure(but(1, 's'))} > 1 OR ({measure(but(1, 's'))} = 1 AND NOT {closed(but(1), but(1, 's'))})) THEN {but(1)} ELSE x END""",
    f"CASE WHEN ends_with(x, 'll') AND {measure('s')} > 1 THEN {but(1)} ELSE x END",
]


def stems_sql(tokens: str) -> str:
    """``w, st`` for a select of distinct tokens ``w``."""
    rows = f"SELECT w, w AS x FROM ({tokens})"
    for step in STEPS:
        rows = f"SELECT w, {step} AS x FROM (SELECT w, x, {SHAPE} AS s FROM ({rows}))"
    own = " ".join(f"WHEN '{w}' THEN '{st}'" for w, st in IRREGULAR.items())
    return f"SELECT w, CASE WHEN length(w) < {SHORTEST_STEMMED} THEN w ELSE CASE w {own} ELSE x END END AS st FROM ({rows})"
