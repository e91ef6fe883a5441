"""The pipeline, stage by stage, against plain versions on the smallest tables."""

import hashlib
import os

import brute

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_stages_match_plain_versions(spark):
    import public_tokenizers as P

    import corpus_pipeline as pipeline
    from whorl.llm import decontaminate, pii, tokens

    source = spark.read.parquet(f"{SF}/documents.parquet")
    docs, rows = source, {r["doc_id"]: r["text"] for r in source.collect()}
    done = []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        done.append({r["doc_id"]: r for r in docs.collect()})
        assert docs.columns == source.columns or stage is pipeline.STAGES[-1][1]
    good = {}
    for i, t in rows.items():
        n, *_, repeated = brute.quality_counts(t)
        if n >= 20 and 100 * repeated <= 30 * n:  # too few labels here to certify cutoffs
            good[i] = t
    assert set(done[0]) == set(good)
    parts = brute.jaccard_components(sorted(good.items()), 5, 80)
    first = {i: t for i, t in good.items() if parts[i][1] == i}
    assert set(done[1]) == set(first)
    items = [brute.WORD.findall(brute.lower(r["text"])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = set()
    for i, t in first.items():
        w = brute.WORD.findall(brute.lower(t))
        known = set(w)
        near = [x for x in items if sum(y not in known for y in x) <= decontaminate.edits(len(x), 20)]
        if not any(brute.edit_distance_inside(x, w) <= decontaminate.edits(len(x), 20) for x in near):
            clean.add(i)
    assert set(done[2]) == clean
    field = pii._field(source.where(source.doc_id.isin(list(clean))), "text", pii.SAMPLE_ROWS)
    own = tokens.load(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    for i in clean:
        text = pii.masked(first[i], pii.find(first[i], field))
        assert done[3][i]["text"] == text and done[3][i]["n_chars"] == len(text)
        assert not brute.pii_base(text)
        ids = own.encode_ordinary(text)
        assert done[4][i]["n_tokens"] == len(ids)
        assert done[4][i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert done[4][i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert pipeline.run(spark, SF).count() == len(clean)
