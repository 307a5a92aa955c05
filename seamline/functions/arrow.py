"""Running plain Python over Arrow batches, for what JVM functions cannot express or only interpret slowly."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import fixed


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """A plain scan ``df`` in at least ``parts`` partitions (the cores of the session): small files are dealt out to all.

    A scan that has that many partitions already, as every large one has, stays as it is, and so does what is no plain
    scan.  It moves rows but never changes them.
    """
    wanted = parts or df.sparkSession.sparkContext.defaultParallelism
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.collectLeaves().size() != 1 or any(op in plan.toString() for op in ("Aggregate", "Join", "Repartition", "Window", "Union", "LogicalRDD", "MapInArrow", "LocalRelation")):
        return df
    return df if df._jdf.queryExecution().executedPlan().execute().getNumPartitions() >= wanted else df.repartition(wanted)


def tokenizer(aliases: dict[str, list[str]] = fixed.ALIASES, stopwords: Sequence[str] = fixed.STOPWORDS) -> Callable[[str], list[str]]:
    """The same tokens as ``text.tokens``, with what a name or a run gives remembered from one text to the next."""
    name, run, stop = re.compile(fixed.ASCII_TOKEN), re.compile(fixed.CJK_RUN), frozenset(stopwords)
    parts: dict[str, list[str]] = {}
    more: dict[str, list[str]] = {}

    def of_name(t: str) -> list[str]:
        return sorted({t, *(p for p in re.split("[./_-]+", t) if len(p) >= 2)})

    def of_run(s: str) -> list[str]:
        n = len(s)
        return [s, s] if n <= 2 else [s, *(s[i : i + k] for k in (2, 3) for i in range(n - k + 1))]

    def remembered(known: dict[str, list[str]], key: str, fn: Callable[[str], list[str]]) -> list[str]:
        if (found := known.get(key)) is None:
            if len(known) > 200_000:
                known.clear()
            found = known[key] = fn(key)
        return found

    def tokens(text: str) -> list[str]:
        low = text.lower()
        base = [p for t in name.findall(low) for p in remembered(parts, t, of_name)]
        base += [p for s in run.findall(low) for p in remembered(parts, s, of_run)]
        extra = [a for t in base for a in remembered(more, t, lambda t: [a for src, out in aliases.items() if src in t for a in out])] if aliases else []
        return [t for t in base + extra if len(t) >= 2 and t not in stop]

    return tokens


def term_counts(df: DataFrame, keys: Sequence[str], text: str, aliases: dict[str, list[str]]) -> DataFrame:
    """keys, term, n, first, n_tokens: one row for each term of a text, counted where the text is; nothing is shuffled.

    The key columns keep their types; texts without tokens give no row.
    """
    fields = [f for k in keys for f in df.schema.fields if f.name == k]
    struct = T.StructType([*fields, *T._parse_datatype_string("term string, n bigint, first int, n_tokens int").fields])
    out, width, make = to_arrow_schema(struct), len(keys), aliases

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer(make)
        for batch in batches:
            row_of: list[int] = []
            term: list[str] = []
            n: list[int] = []
            first: list[int] = []
            size: list[int] = []
            for k, t in enumerate(batch.column(width).to_pylist()):
                toks = tokens(t) if t else []
                at: dict[str, int] = {}
                for i, w in enumerate(toks):
                    at.setdefault(w, i)
                counts = Counter(toks)
                term += counts
                n += counts.values()
                first += [at[w] for w in counts]
                row_of += [k] * len(counts)
                size += [len(toks)] * len(counts)
            if term:
                index = pa.array(row_of, type=pa.int32())
                columns = [batch.column(i).take(index) for i in range(width)]
                columns += [pa.array(v, type=out.field(width + j).type) for j, v in enumerate((term, n, first, size))]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return df.select(*keys, text).mapInArrow(run, struct)
