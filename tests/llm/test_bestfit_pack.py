import tracemalloc
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from flowloom.llm.bestfit_pack import best_fit, encode, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "\n", "It's  a\tTEST\n\nof 3.14 <|endoftext|>x", "<|ENDOFTEXT|> a", "café \u0301x ΣΑΣ ΟΔΟΣ z\x0b\x1cy", "don't'll 12a3 ...!?", "日本語 テキスト。", "🙂🙂 a🙂b", "İI ǅ ﬁ", "a.,.,b a.,", "é., É,", "A\u0301. Á, K K", "x\u0301. .\u0301"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), max_size=4))
def test_parts_encode_as_whole(parts):
    whole = Tokenizer.from_file(PATH)
    texts = [*parts, " ".join(parts), "\n".join(parts)]
    for text, ids in zip(texts, encode(texts, PATH), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_odd_texts_encode_as_whole():
    whole = Tokenizer.from_file(PATH)
    for text, ids in zip(ODD, encode(ODD, PATH), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_no_word_is_kept_in_a_worker():
    words = [f"{chr(97 + i % 26)}{i:b}".replace("1", "x").replace("0", "y") for i in range(20_000)]
    encode(["a b"], PATH)
    tracemalloc.start()
    encode([" ".join(words), " ".join(words) + "."], PATH)
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 300_000


def test_best_fit_is_valid():
    sizes = np.random.default_rng(1).integers(1, 2049, 5000)
    bins, offsets = best_fit(sizes, 2048)
    spans = sorted(zip(bins.tolist(), offsets.tolist(), sizes.tolist()))
    for (b, o, s), (c, p, _) in zip(spans, spans[1:]):
        assert p == o + s if b == c else p == 0 and o + s <= 2048
    assert len(set(bins.tolist())) <= 1.02 * sizes.sum() / 2048 + 1


def check(rows, texts, capacity=2048):
    whole = Tokenizer.from_file(PATH)
    expected = []
    for doc, text in texts:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        expected += [(doc, k, at, len(x := ids[at : at + capacity]), zlib.crc32(np.array(x, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(expected, key=key)
    at = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert all(x <= capacity for x in at.values())
    return at


def test_edge_cases(spark):
    texts = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 5000), *[(10 + i, t) for i, t in enumerate(ODD)]]
    docs = spark.createDataFrame([(a, b, 1, "x") for a, b in texts], "doc_id long, text string, piece int, item string")
    check(pack(docs, PATH).collect(), texts)
    assert pack(docs.limit(0), PATH).count() == 0


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = check(pack(docs.repartition(7), PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert len(at) <= 1.01 * sum(at.values()) / 2048 + 1
