from tokenizers import Tokenizer
import public_tokenizers

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm import test_linededup, test_packing, test_quality, test_simhash, test_substrdedup


def brute(rows):
    """{doc_id: text} after each of the four filtering stages."""
    kept = [(d, t) for d, t in rows if not test_quality.brute(t)[-1]]
    yield dict(kept)
    kept = [(d, t) for d, _, _, t in test_linededup.brute(kept)]
    yield dict(kept)
    component = test_simhash.brute({d: test_simhash.brute_print(t) for d, t in kept})
    kept = [(d, t) for d, t in kept if component[d] == d]
    yield dict(kept)
    out = test_substrdedup.brute(kept)
    yield {d: (t if gone else old) for (d, _, gone, t), (_, old) in zip(out, kept, strict=True)}


def test_stages_match_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, rows = docs.columns, [(r.doc_id, r.text) for r in docs.collect()]
    for (name, stage), want in zip(corpus_pipeline.STAGES, brute(rows), strict=False):
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = docs.collect()
        assert {r.doc_id: r.text for r in got} == want and len(got) == len(want), name
        assert all(r.n_chars == len(r.text) for r in got)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = [len(test_packing.ids_of(library, t)) // 4 + 1 for t in want.values()]
    test_packing.check(packed, [min(2048, n - at) for n in sizes for at in range(0, n, 2048)], 2048)
    ran = corpus_pipeline.run(spark, SF_SMALL).collect()
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, ran)) == sorted(map(key, packed))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
    assert docs.count() == 0
