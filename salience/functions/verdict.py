"""Judge prompts, completions, slots and prices as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from salience.functions.text import hex_number, keyed_digest, strip

# Fixed values of the output contract.
TAG = "[RESULT]"
NO_TAG = "TIE_2"

CRITERIA = {
    "news": "Consistency, coverage, conciseness and coherence, measured against the reference.",
    "procedural": "Correct steps, complete steps, conciseness and clear order, measured against the reference.",
    "faithfulness": "Faithfulness: which candidate does the source support better?",
    "informativeness": "Informativeness: which candidate covers more of what matters in the source?",
}
TASK = (
    "Compare candidate summaries A and B.\nCRITERIA:\n%s\nREFERENCE SUMMARY:\n%s\n"
    "CANDIDATE A:\n%s\nCANDIDATE B:\n%s\n"
    "Answer as: Feedback: (feedback) [RESULT] (A or B or TIE)\nFEEDBACK:"
)
TASK_WITH_SOURCE = (
    "Compare candidate summaries A and B.\nCRITERIA:\n%s\nSOURCE DOCUMENT:\n%s\nREFERENCE SUMMARY:\n%s\n"
    "CANDIDATE A:\n%s\nCANDIDATE B:\n%s\n"
    "Answer as: Feedback: (feedback) [RESULT] (A or B or TIE)\nFEEDBACK:"
)


def criterion_text(style: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in CRITERIA.items():
        out = F.when(style == name, F.lit(text)).otherwise(out)
    return out


def slot_texts(a: Column, b: Column, a_first: Column) -> tuple[Column, Column]:
    return F.when(a_first, a).otherwise(b), F.when(a_first, b).otherwise(a)


def judge_prompt(style: Column, reference: Column, a: Column, b: Column, a_first: Column) -> Column:
    """System ``a`` is shown in slot A where ``a_first``, else in slot B."""
    slot_a, slot_b = slot_texts(a, b, a_first)
    return F.format_string(TASK, criterion_text(style), reference, slot_a, slot_b)


def source_prompt(style: Column, document: Column, reference: Column, slot_a: Column, slot_b: Column) -> Column:
    """One criterion on a pair that already stands in its slots."""
    return F.format_string(TASK_WITH_SOURCE, criterion_text(style), document, reference, slot_a, slot_b)


def raw_result(completion: Column) -> Column:
    """A, B or TIE after the last tag; a completion without a tag is marked apart."""
    tail = F.upper(strip(F.substring_index(completion, TAG, -1)))
    return (
        F.when(~F.contains(completion, F.lit(TAG)), F.lit(NO_TAG))
        .when(F.startswith(tail, F.lit("A")), F.lit("A"))
        .when(F.startswith(tail, F.lit("B")), F.lit("B"))
        .otherwise(F.lit("TIE"))
    )


def feedback(completion: Column) -> Column:
    """Everything before the last tag, inner tags dropped."""
    before = F.substring_index(completion, TAG, -1)
    head = F.left(completion, F.length(completion) - F.length(before))
    return strip(F.when(~F.contains(completion, F.lit(TAG)), completion).otherwise(F.replace(head, F.lit(TAG), F.lit(""))))


def winner(raw: Column, a_first: Column) -> Column:
    """The system behind the winning slot."""
    return (
        F.when(raw == "A", F.when(a_first, F.lit("a")).otherwise(F.lit("b")))
        .when(raw == "B", F.when(a_first, F.lit("b")).otherwise(F.lit("a")))
        .otherwise(F.lit("tie"))
    )


def winner_by_key(raw: Column, system_a: Column, system_b: Column) -> Column:
    """The same with the slots named by an answer key."""
    return F.when(raw == "A", F.lower(system_a)).when(raw == "B", F.lower(system_b)).otherwise(F.lit("tie"))


def a_in_first_slot(*key) -> Column:
    """An even split over keys that never changes between runs."""
    return hex_number(keyed_digest(*key), 1, 1) < 8


def call_price(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """Rates are per million tokens; an unknown model, with NULL rates, costs nothing."""
    cost = (tokens_in * rate_in + tokens_out * rate_out) / F.lit(1e6)
    return F.coalesce(cost, F.lit(0.0))


def p_text(p: Column) -> Column:
    return F.when(p < 0.0001, F.format_string("%.2e", p)).otherwise(F.format_string("%.4f", p))


def p_cell(p: Column, direction: Column, alpha: float = 0.05) -> Column:
    mark = F.when(p < alpha, F.lit("*")).otherwise(F.lit(" "))
    sign = F.when(direction == "HIGHER", F.lit("(+)")).when(direction == "LOWER", F.lit("(-)")).otherwise(F.lit("(?)"))
    return F.when(p.isNull(), F.lit("-- missing --")).otherwise(F.concat(p_text(p), F.lit(" "), mark, sign))
