from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa

import corpus_pipeline
from cadenza.llm import language_id, mixing, packing
from cadenza.llm.common import staged
from cadenza.llm.textbytes import column_bytes
from tests.llm.brute import jaccard_components
from tests.llm.helpers import documents, empty, odd


def identified(docs, rows):
    """The rows whose language is told, text by text and with decoding from the definition."""
    model = language_id.learn(docs)
    out = []
    for r in rows:
        if not r.text or not any(ch.isalpha() for ch in r.text):
            continue
        x = language_id.features(language_id.trigram_counts(column_bytes(pa.array([r.text]))[0]))
        margins = x @ model.weights + model.bias
        loss = [float(sum(t * np.log1p(np.exp(-m * b)) for m, b, t in zip(margins, word, model.trust, strict=True))) for word in model.code]
        share = np.exp(min(loss) - np.array(loss))
        if share.max() / share.sum() >= language_id.SURE:
            out.append((r.doc_id, r.text))
    return out


def test_each_stage_against_a_plain_version(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "jaccard_join", "mix_sources", "pack_sequences"]
    rows = documents(spark, sf_dir)
    columns, kept, read = rows.columns, [], [rows]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = staged(stage(spark, rows, sf_dir), f"test-{name}")
        assert rows.columns == columns
        read.append(rows)
        kept.append(sorted((r.doc_id, r.text) for r in rows.collect()))
    told = sorted(identified(read[0], read[0].collect()))
    assert kept[0] == told and len(told) >= 0.99 * read[0].count()
    last = {}
    for i, t in kept[0]:
        last[t] = max(i, last.get(t, i))
    assert kept[1] == sorted((i, t) for t, i in last.items())
    component = jaccard_components(kept[1], 5, 80)
    assert kept[2] == [(i, t) for i, t in kept[1] if component[i][1] == i or not component[i][0]]
    read[3].write.parquet(str(tmp_path / "mixed_from"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/mixed_from/*.parquet'")
    taken = {i: n // size for i, size, _, _, n in con.sql(mixing.OP1_SQL).fetchall() if n}
    assert Counter(i for i, _ in kept[3]) == Counter(taken)
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir).collect()
    tokenizer = packing.PieceTokenizer(packing.public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {i: len(tokenizer.ids(t)) + 1 for i, t in dict(kept[3]).items()}
    held = Counter()
    for r in packed:
        assert r.doc_tokens == tokens[r.doc_id] and 0 <= r.start < r.start + r.length <= r.doc_tokens and r.offset + r.length <= 2048
        held[r.doc_id] += r.length
    assert held == Counter({i: n * taken[i] for i, n in tokens.items()})


def test_odd_and_empty_tables_pass_through_all_stages(spark):
    for docs in (odd(spark), empty(spark), odd(spark).where("text IS NULL OR trim(text) = ''")):
        rows = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = staged(stage(spark, rows, ""), f"odd-{name}")
            assert rows.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, rows, "").count() >= rows.count()
    by_stage = odd(spark).where("doc_id IS NULL OR doc_id <> 2")
    assert corpus_pipeline.exact(spark, by_stage, "").count() == 8  # one row of each text: 1 gives way to 5, one of 7 stays
