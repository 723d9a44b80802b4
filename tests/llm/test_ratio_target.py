"""Operator 2's target counts every trusted row."""

import numpy as np

from lodestar.llm import ratio
from lodestar.llm.common import offsets
from lodestar.llm.textstats import Texts


def counts(texts):
    import pyarrow as pa

    return np.bincount(ratio.buckets(Texts(*offsets(pa.array(texts))))[1].astype(np.int64), minlength=ratio.BUCKETS)


def test_target_is_whole(spark, monkeypatch):
    # more trusted rows than the 20,000 once counted; repeated labels and rows, null ids, labels without a document
    texts = [f"w{i % 7} v{i} u{i % 1000}" for i in range(24_000)]
    rows = [*enumerate(texts), (5, texts[5]), (None, "no id"), (7, None)]
    trusted = lambda i: i is not None and i % 12 != 0
    marks = [(i, int(trusted(i))) for i in range(24_000)] + [(5, 1), (None, 1), (12, None), (10**9, 1)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    seen, plain = [], ratio.log_ratio
    monkeypatch.setattr(ratio, "log_ratio", lambda raw, own: seen.append((raw, own)) or plain(raw, own))
    assert ratio.judged(docs, labels).count() == len(rows)
    raw, own = seen[0]
    assert (raw == counts([t for _, t in rows])).all()
    assert (own == counts([t for i, t in rows if trusted(i)])).all()
