"""Expressions over score vectors in taxonomy order.

The vectors have a fixed, small length, so they are unrolled into scalar
expressions: unlike higher-order functions these stay inside generated code.
Unrolled expressions are written as Spark SQL text (``str``), which Spark parses
in one go; building the same tree call by call costs seconds. ``F.expr`` makes a
column of a text. An item a vector does not have reads as null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shellsieve.taxonomy import DEFAULT_THRESHOLD, TAXONOMY, Taxonomy


def lit(value: float | str) -> str:
    """A literal in SQL text; floats are doubles, never decimals."""
    if isinstance(value, str):
        return "'" + value.replace("'", "\\'") + "'"
    return f"{float(value)!r}D"


def array(parts: list[str]) -> str:
    return f"array({', '.join(parts)})"


def id_array(ids) -> str:
    return array([lit(i) for i in ids])


def items(vector: str, start: int, stop: int) -> list[str]:
    return [f"get({vector}, {i})" for i in range(start, stop)]


def softmax(logits: list[str]) -> list[str]:
    """Max-shifted softmax."""
    top = f"greatest({', '.join(logits)})"
    exps = [f"exp({x} - {top})" for x in logits]
    return [f"({e} / ({' + '.join(exps)}))" for e in exps]


def sigmoid(x: str) -> str:
    """Stable for large |x|: the exponent is never positive."""
    z = f"exp(-abs({x}))"
    return f"(CASE WHEN {x} >= 0 THEN 1D / (1D + {z}) ELSE {z} / (1D + {z}) END)"


def probabilities(logits: str, tax: Taxonomy = TAXONOMY) -> str:
    """Logits to one probability vector: softmax of the verdicts, then sigmoids."""
    nv = len(tax.verdict_ids)
    return array(softmax(items(logits, 0, nv)) + [sigmoid(x) for x in items(logits, nv, tax.size)])


def rounded(parts: list[str], digits: int | None) -> list[str]:
    return parts if digits is None else [f"round({p}, {digits})" for p in parts]


def argmax_index(scores: list[str]) -> str:
    """0-based position of the largest item; the first one wins a tie."""
    top = f"greatest({', '.join(scores)})"
    cases = " ".join(f"WHEN {s} = {top} THEN {i}" for i, s in enumerate(scores))
    return f"(CASE {cases} END)"


def pick(index: str, ids) -> str:
    return f"get({id_array(ids)}, {index})"


# --- sets of actions as bits of one BIGINT -----------------------------------

def mask_of_flags(flags: list[str]) -> str:
    return "(" + " | ".join(f"IF({f}, {1 << i}L, 0L)" for i, f in enumerate(flags)) + ")"


def mask_of_names(names: str, tax: Taxonomy = TAXONOMY) -> Column:
    """Unknown names set no bit; a null list is the empty set."""
    return F.expr(mask_of_flags([f"coalesce(array_contains({names}, {lit(a)}), false)" for a in tax.action_ids]))


def mask_of_name(name: str, tax: Taxonomy = TAXONOMY) -> Column:
    cases = " ".join(f"WHEN {lit(a)} THEN {1 << i}L" for i, a in enumerate(tax.action_ids))
    return F.expr(f"CASE {name} {cases} ELSE 0L END")


def overlaps(mask: str, bits: int) -> str:
    return f"(({mask} & {bits}L) != 0L)"


def names_of_mask(mask: str, bits_by_name: dict[str, int]) -> Column:
    """Names whose bits meet the mask, in the order of the mapping."""
    return F.expr("array_compact(" + array([f"IF({overlaps(mask, b)}, {lit(n)}, NULL)" for n, b in bits_by_name.items()]) + ")")


def actions_of_mask(mask: str, tax: Taxonomy = TAXONOMY) -> Column:
    return names_of_mask(mask, {a: 1 << i for i, a in enumerate(tax.action_ids)})


def tactics_of_mask(mask: str, tax: Taxonomy = TAXONOMY) -> Column:
    return names_of_mask(mask, tax.tactic_bits)


def techniques_of_mask(mask: str, tax: Taxonomy = TAXONOMY) -> Column:
    return names_of_mask(mask, tax.technique_bits)


# --- teacher (soft label) vectors --------------------------------------------

def well_formed(soft: Column, tax: Taxonomy = TAXONOMY) -> Column:
    """The vector if it has exactly one value per label, else null."""
    return F.when(F.size(soft) == tax.size, soft)


def hard_verdict(soft: str, tax: Taxonomy = TAXONOMY) -> Column:
    return F.expr(pick(argmax_index(items(soft, 0, len(tax.verdict_ids))), tax.verdict_ids))


def hard_action_mask(soft: str, threshold: float = DEFAULT_THRESHOLD, tax: Taxonomy = TAXONOMY) -> str:
    return mask_of_flags([f"{x} >= {lit(threshold)}" for x in items(soft, len(tax.verdict_ids), tax.size)])


def hard_labels(soft: str, threshold: float = DEFAULT_THRESHOLD, tax: Taxonomy = TAXONOMY) -> Column:
    """``[verdict] ++ actions`` from a vector of probabilities."""
    scores = items(soft, len(tax.verdict_ids), tax.size)
    actions = array([f"IF({x} >= {lit(threshold)}, {lit(a)}, NULL)" for a, x in zip(tax.action_ids, scores)])
    return F.concat(F.array(hard_verdict(soft, tax)), F.expr(f"array_compact({actions})"))


def soft_of_answers(answers: str, tax: Taxonomy = TAXONOMY, verdict_key: str = "__verdict__") -> Column:
    """Decode ``map<string, struct<probabilities: map<string,double>, noul: double>>``.

    A missing answer or probability counts as 0.
    """
    verdicts = [f"coalesce({answers}[{lit(verdict_key)}].probabilities[{lit(v)}], 0D)" for v in tax.verdict_ids]
    actions = [f"coalesce({answers}[{lit(a)}].noul, 0D)" for a in tax.action_ids]
    return F.expr(array(verdicts + actions))


def soft_targets(soft: str, true_labels: str, tax: Taxonomy = TAXONOMY) -> Column:
    """label -> probability when a well-formed vector exists, else label -> 0/1."""
    hard = array([f"cast(array_contains({true_labels}, {lit(i)}) AS double)" for i in tax.all_ids])
    return F.expr(f"map_from_arrays({id_array(tax.all_ids)}, IF(size({soft}) = {tax.size}, {soft}, {hard}))")
