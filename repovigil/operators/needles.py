"""All needles of all rules in one pass over a text.

Risky lines and control evidence are looked for in texts that hold a needle of their rule. Asking each text
for each needle reads it once per needle; here a multi-pattern automaton, compiled once per worker, reads it
once and answers with one bit a rule.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from repovigil.operators import rules

#: One bit for each rule: first the risky patterns, then the controls.
_NEEDLES = [rule[2] for rule in rules.VULNERABILITY_RULES] + [entry[-1] for entry in rules.CONTROLS]


@lru_cache(1)
def _automaton():
    import ahocorasick

    bits: dict[str, int] = {}
    for k, needles in enumerate(_NEEDLES):
        for needle in needles:
            bits[needle] = bits.get(needle, 0) | 1 << k
    automaton = ahocorasick.Automaton()
    for needle, rule_bits in bits.items():
        automaton.add_word(needle, rule_bits)
    automaton.make_automaton()
    return automaton


def _search(texts: pa.Array) -> pa.Array:
    automaton, every, found = _automaton(), (1 << len(_NEEDLES)) - 1, []
    for text in texts:
        bits = 0
        for _, rule_bits in automaton.iter(text.as_py() or ""):
            bits |= rule_bits
            if bits == every:
                break
        found.append(bits)
    return pa.array(found, pa.int64())


def needle_bits(text: Column) -> Column:
    """The rules that a text holds a needle of, as bits; none for a null text."""
    return F.arrow_udf(_search, "bigint")(text)


def risky(bits: Column, rule: int) -> Column:
    """Whether the text may have a line of this risky pattern."""
    return bits.bitwiseAND(1 << rule) != 0


def protective(bits: Column, control: int) -> Column:
    """Whether the text shows this control."""
    return bits.bitwiseAND(1 << len(rules.VULNERABILITY_RULES) + control) != 0
