"""Which of many patterns occur in which texts: each text is read once, whatever the number of patterns."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of texts that one task matches against a group's patterns, about.
SLOT_BYTES = 4 << 20


def contained(texts: DataFrame, patterns: DataFrame, within: list[str], text: str, pattern: str, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """within..., text, pattern: the patterns of a group that occur in its texts, each pair once.

    A group's distinct texts are dealt to as many slots as their bytes need, each with an Aho-Corasick automaton of
    the group's distinct patterns, so a group of many texts is no single task. The columns of
    `within` are strings; a null is a group as any other. Empty or null texts and patterns occur nowhere.
    """
    own = texts.select(*within, F.col(text).alias("text")).where("text <> ''").distinct()
    sizes = own.groupBy(*[F.col(c).alias(f"{c}__s") for c in within]).agg(F.ceil(F.sum(F.octet_length("text")) / F.lit(slot_bytes)).cast("int").alias("slots"))
    agree = F.lit(True)
    for c in within:
        agree = agree & F.col(c).eqNullSafe(F.col(f"{c}__s"))
    keep = [F.col(c) for c in within]
    dealt = own.join(sizes, agree).select(*keep, F.pmod(F.xxhash64("text"), F.col("slots")).cast("int").alias("slot"), "text")
    wanted = patterns.select(*within, F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    wanted = wanted.join(sizes, agree).select(*keep, F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "pattern")
    names = [*within, "text", "pattern"]

    def match(some: pa.Table, known: pa.Table) -> pa.Table:
        import ahocorasick

        out = []
        if some.num_rows and known.num_rows:
            search = ahocorasick.Automaton()
            for p in known.column("pattern").to_pylist():
                search.add_word(p, p)
            search.make_automaton()
            group = [some.column(c)[0].as_py() for c in within]
            for t in some.column("text").to_pylist():
                out += [(*group, t, p) for p in dict.fromkeys(p for _, p in search.iter(t))]
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.Table.from_arrays([pa.array(c, pa.string()) for c in columns], names=names)

    by = [*within, "slot"]
    return dealt.groupBy(*by).cogroup(wanted.groupBy(*by)).applyInArrow(match, ", ".join(f"`{n}` string" for n in names)).withColumnsRenamed({"text": text, "pattern": pattern})
