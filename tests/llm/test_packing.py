import random
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foldspark.llm import packing
from tests.conftest import SF_SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return b"".join(i.to_bytes(4, "little") for i in library.encode(text, add_special_tokens=False).ids)


def plain_best_fit(lengths, capacity):
    """Sequences that best fit opens, one piece after the other."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = min((g for g in gaps if g >= n), default=None)
        if fit is None:
            gaps.append(capacity - n)
        else:
            gaps[gaps.index(fit)] -= n
    return len(gaps)


def check(out, lengths, capacity):
    """Every piece once, gapless and within the sequences; as few of them as plain best fit."""
    assert sorted(r.length for r in out) == sorted(lengths)
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(held) == plain_best_fit(lengths, capacity)


def test_words_match_library(library):
    bpe = packing.WordBpe(PATH)
    rng = random.Random(11)
    odd = [
        "", "Don't STOP we'LL x's 12 3a4b ... ,.;", "İstanbul ΣΑΣ ς K Å ﬁ é é 漢字🙂", "a\x1cb\x1d c\x85d\xa0e f", "<|endoftext|> x<|startoftext|>y <|end",
        "q" * 300, "~~~!!!", "ÀÉÎ ñandú Straße groß ÆØÅ ſ ı ŉ", "a.b,c!d? e.. f., ''s 'S",
    ]
    letters = "abcdefghij ETAOIN.,'!?-0123 \n\tàéîõüßÆŁ漢Σσ<>|#$%"
    odd += ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(500)]
    for text in odd:
        assert bpe.encode(text) == ids_of(library, text), text


def test_vocabulary_round_trip(library):
    """Every token of letters, as a word of its own and inside words."""
    bpe = packing.WordBpe(PATH)
    words = [t.removesuffix("</w>") for t in library.get_vocab() if t.isascii() and t.removesuffix("</w>").isalpha()][:20000]
    text = " ".join(words) + " " + " ".join(a + b for a, b in zip(words, words[7:], strict=False))
    assert bpe.encode(text) == ids_of(library, text)


def test_best_fit_plan():
    rng = random.Random(2)
    for capacity in (1, 2, 10, 100):
        for _ in range(40):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(60))]
            plan = packing.best_fit({n: lengths.count(n) for n in set(lengths)}, capacity)
            used = {}
            for size, _, taken, each, first, offset in plan.tolist():
                for k in range(taken):
                    used.setdefault(first + k // each, []).append((offset + k % each * size, size))
            for places in used.values():
                end = 0
                for offset, size in sorted(places):
                    assert offset == end
                    end += size
                assert end <= capacity
            assert len(used) == plain_best_fit(lengths, capacity)


def test_documents(spark, library):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = packing.pack_documents(docs, PATH).collect()
    want = []
    for doc_id, text in texts.items():
        ids = ids_of(library, text) + b"\0\0\0\0"
        for n, at in enumerate(range(0, len(ids), 4 * 2048)):
            cut = ids[at : at + 4 * 2048]
            want.append((doc_id, n, at // 4, len(cut) // 4, zlib.crc32(cut)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    check(out, [w[3] for w in want], 2048)


def test_odd_tables(spark):
    rows = [(None, "a b c", 1), (1, None, 1), (1, "", 1), (1, "", 1), (2, "w " * 100, 1), (None, "a b c", 1), (3, "x y " * 7, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    out = packing.pack_documents(docs, PATH, 16).collect()
    check(out, [4, 1, 1, 1, *[16] * 6, 5, 4, 15], 16)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
