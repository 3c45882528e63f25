"""Cutting byte spans out of documents: the last step of the operators that remove repeated text."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_KEY, row_key, text_view


def union_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, end); touching spans are one run."""
    if len(start) == 0:
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    first = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[first], reach[np.r_[first[1:] - 1, len(start) - 1]]


def bytes_in(docs: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of a text column; sizes the number of buckets."""
    return int(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)


def cut(docs: DataFrame, marks: DataFrame, to_spans, key: str = "doc_id", text: str = "text", with_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs: key, text, and the columns to keep. marks: k1_, k2_ (as from row_key), mark (binary), any number of rows a document. to_spans(list of marks) gives the
    (start, end) arrays to remove. Returns key, n_bytes, n_removed, n_spans, kept_sha256, removed (array of start, end
    in bytes of the original) and, on request, kept_text; one row for each row of docs, marked or not."""
    gathered = marks.groupBy(*ROW_KEY).agg(F.collect_list("mark").alias("marks_"))
    rest = F.struct(F.col(key).alias("own_"), *[F.col(c).alias(f"c{i}_") for i, c in enumerate(keep)])
    joined = docs.select(*row_key(key, text), F.col(text).alias("body_"), rest.alias("rest_")).join(gathered, list(ROW_KEY), "left").select("body_", "marks_", "rest_")
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    fields = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(span))]
    fields += [("kept_text", pa.string())] * with_text
    schema = pa.schema(fields)

    def run(batches):
        for batch in batches:
            data, off = text_view(batch.column("body_"))
            view, marks_ = memoryview(data), batch.column("marks_")
            out = {name: [] for name, _ in fields}
            for i in range(batch.num_rows):
                body, n = view[off[i] : off[i + 1]], int(off[i + 1] - off[i])
                start = end = np.zeros(0, np.int64)
                if marks_[i].is_valid:
                    start, end = union_spans(*to_spans(marks_[i].as_py()))
                kept = bytes(body) if len(start) == 0 else b"".join(bytes(body[a:b]) for a, b in zip(np.r_[0, end], np.r_[start, n], strict=True))
                out["n_bytes"].append(n)
                out["n_removed"].append(n - len(kept))
                out["n_spans"].append(len(start))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["removed"].append([{"start": a, "end": b} for a, b in zip(start.tolist(), end.tolist(), strict=True)])
                if with_text:
                    out["kept_text"].append(kept.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([*[pa.array(out[n], t) for n, t in fields], batch.column("rest_")], names=[*schema.names, "rest_"])

    ddl = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:int,end:int>>" + ", kept_text string" * with_text
    ddl += f", rest_ {dict(joined.dtypes)['rest_']}"
    return joined.mapInArrow(run, ddl).select(F.col("rest_.own_").alias(key), *schema.names, *[F.col(f"rest_.c{i}_").alias(c) for i, c in enumerate(keep)])
