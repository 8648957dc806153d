"""Deduplication of an unbounded ingest log with state by identity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

OUTPUT = "kind string, digest string, ord long, outcome string"


def _judge(key, frames, state):
    kind, digest = key
    first = state.get if state.exists else None
    # the first of a trigger may be in any of its chunks
    held = list(frames)
    for f in [pd.concat(held).sort_values("ord", kind="stable")] if held else []:
        out = []
        for o, sha, size in zip(f["ord"].tolist(), f["body_sha256"].tolist(), f["size"].tolist()):
            if first is None:
                first = (sha, size)
                out.append((kind, digest, o, "accepted"))
            else:
                out.append((kind, digest, o, "duplicate" if (sha, size) == tuple(first) else "conflict"))
        yield pd.DataFrame(out, columns=["kind", "digest", "ord", "outcome"])
    state.update(first)


def outcomes(stream: DataFrame) -> DataFrame:
    """outcome of every arriving row: identities are remembered for the life of the query, never evicted."""
    return stream.groupBy("kind", "digest").applyInPandasWithState(_judge, OUTPUT, "sha string, size long", "append", GroupStateTimeout.NoTimeout)
