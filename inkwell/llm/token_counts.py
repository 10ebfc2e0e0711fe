"""Token counts by field and section, from one encoding of each whole document.

The fields of a document are joined by line feeds and encoded once.  The byte lengths of the ids give each token's span;
an interval join of those spans with the sections' spans (both sorted, so by bisection) attributes the tokens.  A token
that crosses a section's end is allocated by an explicit rule.  Places are given in characters (code points).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.bpe import of_worker, shipped
from inkwell.llm.text import kept_columns, map_texts, quoted

#: first: to the section with the token's first byte; last: with its last; most: with most of its bytes (the first, if
#: equal); split: shared out in proportion to its bytes.
RULES = ("first", "last", "most", "split")


def attributed(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section [bounds[i], bounds[i + 1]), and how many of the tokens with a byte in it cross its bounds.

    ``ends`` are the tokens' ends; they cover [0, bounds[-1]) in turn.  Sections may be empty.
    """
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
    n = len(bounds) - 1
    inner = bounds[1:-1]
    # the token that goes over each inner bound, if any
    over = np.searchsorted(ends, inner, side="right")
    crossing = np.zeros(len(inner), bool)
    inside = over < len(ends)
    crossing[inside] = starts[over[inside]] < inner[inside]
    crossers = np.unique(over[crossing])
    # the first and last section of a token: the last one that begins at or before its first and its last byte
    first = np.searchsorted(bounds[:-1], starts[crossers], side="right") - 1
    last = np.searchsorted(bounds[:-1], ends[crossers] - 1, side="right") - 1
    touched = np.zeros(n, np.int64)
    whole = (np.searchsorted(starts, bounds[1:]) - np.searchsorted(starts, bounds[:-1])).astype(np.float64)  # rule "first"
    np.subtract.at(whole, first, 1)
    for t, a, b in zip(crossers, first, last, strict=True):
        share = np.minimum(bounds[a + 1 : b + 2], ends[t]) - np.maximum(bounds[a : b + 1], starts[t])
        touched[a : b + 1] += share > 0
        if rule == "split":
            whole[a : b + 1] += share / (ends[t] - starts[t])
        else:
            whole[{"first": a, "last": b, "most": a + int(share.argmax())}[rule]] += 1
    return whole, touched


def token_counts(
    docs: DataFrame, tokenizer_path: str, *, keep: list[str] | None = None, fields: tuple[str, ...] = ("text",), rule: str = "first", sections: bool = True, special_as_text: bool = False
) -> DataFrame:
    """One row per section: ``keep``, ``field``, ``section`` (from 0), ``char_start``, ``char_end``, ``n_tokens``, ``n_crossing``.

    A section is a line with its line feed (``sections=False``: the whole field); the line feed that joins two fields
    belongs to the end of the first.  Places count from the start of the joined text.  A null or empty field has one
    empty section with no tokens, so no document is lost; the tokens of a document always add up to its encoding.
    ``n_crossing`` counts the tokens with a byte in the section and one outside.  Repeated rows are counted each, an empty
    table has no sections, and input columns named like a result are replaced.  Read in place, no shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kept, columns, own = kept_columns(docs, ["doc_id"] if keep is None else keep, {"field", "section", "char_start", "char_end", "n_tokens", "n_crossing"})
    keep = [f.name for f in own]
    config = shipped(docs.sparkSession, tokenizer_path)
    names = list(fields)
    values = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in names]
    source = docs.select(*columns, F.concat_ws("\n", *values).alias("__joined"), F.array(*[F.octet_length(v) for v in values]).alias("__sizes"))
    # the sizes ride in front of the text, so that one column of whole texts goes to Python
    source = source.withColumn("__joined", F.concat(F.concat_ws(",", "__sizes"), F.lit("\n"), F.col("__joined")))
    row = T.StructType([T.StructField("field", T.StringType()), *[T.StructField(c, T.IntegerType() if c == "section" else T.LongType()) for c in ("section", "char_start", "char_end")], T.StructField("n_tokens", T.DoubleType()), T.StructField("n_crossing", T.LongType())])

    def make():
        bpe = of_worker(config.value, special_as_text)
        length = bpe.lengths

        def work(texts: list[bytes]) -> list:
            heads = [t.index(b"\n") for t in texts]
            sizes = [list(map(int, t[:h].split(b","))) for t, h in zip(texts, heads, strict=True)]
            texts = [t[h + 1 :] for t, h in zip(texts, heads, strict=True)]
            ids, counts = bpe.encode(texts)
            cut = np.concatenate([[0], np.cumsum(counts)])
            out = {f.name: [] for f in row}
            rows = []
            for text, size, a, b in zip(texts, sizes, cut[:-1], cut[1:], strict=True):
                ends = np.cumsum(length[ids[a:b]])
                raw = np.frombuffer(text, np.uint8)
                lines = np.flatnonzero(raw == 10) + 1
                bounds, field, number, at = [np.zeros(1, np.int64)], [], [], 0
                for k, s in enumerate(size):
                    end = at + s + (k < len(size) - 1)
                    inner = lines[(lines > at) & (lines < end)] if sections else lines[:0]
                    bounds += [inner, np.array([end])]
                    field += [names[k]] * (len(inner) + 1)
                    number.append(np.arange(len(inner) + 1))
                    at = end
                bounds = np.concatenate(bounds)
                whole, touched = attributed(ends, bounds, rule)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[bounds]
                rows.append(len(field))
                out["field"] += field
                for name, x in (("section", np.concatenate(number)), ("char_start", chars[:-1]), ("char_end", chars[1:]), ("n_tokens", whole), ("n_crossing", touched)):
                    out[name].append(x)
            flat = [pa.array(out["field"], pa.string())]
            for f, kind in (("section", np.int32), ("char_start", np.int64), ("char_end", np.int64), ("n_tokens", np.float64), ("n_crossing", np.int64)):
                flat.append(pa.array(np.concatenate(out[f]).astype(kind)))
            made = pa.StructArray.from_arrays(flat, names=[f.name for f in row])
            return [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *rows]), pa.int32()), made)]

        return work

    counted = map_texts(source, "__joined", keep, [T.StructField("__rows", T.ArrayType(row))], make)
    counted = counted.select(*keep, F.explode("__rows").alias("__row"))
    tokens = F.col("__row.n_tokens") if rule == "split" else F.col("__row.n_tokens").cast("long").alias("n_tokens")
    found = counted.select(*keep, "__row.field", "__row.section", "__row.char_start", "__row.char_end", tokens, "__row.n_crossing")
    return found.toDF(*kept, *found.columns[len(keep) :])
