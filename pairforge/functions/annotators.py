"""Named entities by any annotator: distinct texts in batches, one annotator loaded by each worker.

An annotator takes a list of texts and gives, for each, pairs of a span's text and its label. What loads it is named by a
key; a worker process that has loaded it keeps it for its next tasks.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions import constraints as C
from pairforge.functions.text import keyed_texts, normalize, tokenize, with_both
from pairforge.session import ready, scratch, written

Annotator = Callable[[list[str]], list[list[tuple[str, str]]]]

# Labels of places, of dates, and those that numbers and dates stand for already.
PLACES = ["GPE", "LOC", "FAC"]
TIMES = ["DATE", "TIME"]
SKIPPED = ["CARDINAL", "ORDINAL", "QUANTITY", "PERCENT", "MONEY", "DATE", "TIME"]

PREFIXES = {"date": "all_dates", "ents": "named", "loc": "places"}
GROUPS = C.GROUPS | {group: [f"{p}_{x}" for x in C.PARTS] for group, p in (("date", "date"), ("entity_named", "ents"), ("location", "loc"))}
BATCH = 1000


class Rules:
    """An annotator of patterns: a label and the expression whose first group is the span."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = [(label, re.compile(pattern)) for label, pattern in rules]

    def __call__(self, texts: list[str]) -> list[list[tuple[str, str]]]:
        return [[(m[1], label) for label, pattern in self.rules for m in pattern.finditer(text)] for text in texts]


def loaded(key: str, load: Callable[[], Annotator]) -> Annotator:
    """This process's annotator of that key."""
    kept = sys.modules.setdefault("_pairforge_annotators", type(sys)("_pairforge_annotators"))
    if key not in kept.__dict__:
        setattr(kept, key, load())
    return kept.__dict__[key]


def spans(texts: DataFrame, column: str, key: str, load: Callable[[], Annotator], batch: int = BATCH) -> DataFrame:
    """Adds _spans, an array of text and label, to texts. A null text is not given to the annotator and has none."""
    ready(texts.sparkSession)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema) + ", _spans array<struct<text:string,label:string>>"
    kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string())]))

    def scan(batches):
        annotator = loaded(key, load)
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                given = part.column(part.schema.get_field_index(column)).to_pylist()
                found = annotator([t for t in given if t is not None])
                if len(found) != sum(t is not None for t in given):
                    raise ValueError(f"annotator {key} gave {len(found)} results")
                each = iter(found)
                made = [[] if t is None else [{"text": a, "label": b} for a, b in next(each)] for t in given]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, kind)], names=[*part.schema.names, "_spans"])

    return texts.mapInArrow(scan, schema)


def annotate(texts: DataFrame, column: str, key: str, load: Callable[[], Annotator], into: str = "ann") -> DataFrame:
    """The annotations of constraints.annotate with three more sets: named (places are in it), places, all_dates (patterns and annotator)."""
    found = C.annotate(spans(texts, column, key, load), column, into)
    canon = F.transform(
        F.col("_spans"),
        lambda s: F.struct(F.trim(F.regexp_replace(F.array_join(tokenize(normalize(s["text"], compose=False)), " "), "^the ", "")).alias("text"), s["label"].alias("label")),
    )
    found = found.withColumn("_canon", F.filter(canon, lambda s: s["text"] != ""))
    of = lambda keep: F.array_distinct(F.transform(F.filter("_canon", keep), lambda s: s["text"]))
    more = {
        "named": of(lambda s: s["label"].isin(PLACES) | ~s["label"].isin(SKIPPED)),
        "places": of(lambda s: s["label"].isin(PLACES)),
        "all_dates": F.array_union(F.col(f"{into}.dates"), of(lambda s: s["label"].isin(TIMES))),
    }
    ann = F.col(into)
    for name, column_ in more.items():
        ann = ann.withField(name, column_)
    return found.withColumn(into, ann).drop("_spans", "_canon")


def named_features(pairs: DataFrame, key: str, load: Callable[[], Annotator], texts: DataFrame | None = None) -> DataFrame:
    """Adds the columns of all nine GROUPS to pairs (question1, question2). Each distinct text is annotated once.

    With texts (_key, _text), pairs have the keys _k1 and _k2 in place of the texts and keep them, but no annotations.
    """
    out, known = keyed_texts(pairs, texts)
    known = annotate(known, "_text", key, load).drop("_text")
    out = with_both(out, known if texts is None else C.slim(known), "ann", ("a1", "a2"))
    made = {}
    for prefix, field in PREFIXES.items():
        made |= C.consistency("a1", "a2", field, prefix)
    out = C.agreement(out.drop("_k1", "_k2") if texts is None else out).withColumns(made)
    return out if texts is None else out.drop("a1", "a2")
