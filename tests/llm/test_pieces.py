from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pieces
from tidemark.llm.queries import MODEL

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer file")
TEXTS = ["", "Hello  world", "  lead", " a\tb\nc", "é̂ ﬁ Ⅻ", "x ", "日本𝕏", "a▁b", "\x00z", "<s> </s> <0x41>", "a" * 300, "the theory of everything, " * 50, "    def f(x):\n\t\treturn x**2", "Donaudampfschifffahrtsgesellschaft"]


@pytest.fixture(scope="module")
def both():
    import sentencepiece

    return pieces.Coder(pieces.Model.load(MODEL)), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_equal_the_library(both):
    coder, library = both
    assert coder.encode(TEXTS) == library.encode(TEXTS)
    assert [coder.decode(i) for i in coder.encode(TEXTS)] == [t.replace("▁", " ") for t in TEXTS]
    assert coder.encode([None, "x"])[0] is None and coder.decode(None) is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aeinrst th.,▁ \n"), st.characters(blacklist_categories=("Cs",))), max_size=50), min_size=1, max_size=20))
def test_ids_equal_the_library_on_random_texts(both, texts):
    coder, library = both
    assert coder.encode(texts) == library.encode(texts)


def unigram(spec, path):
    """A small unigram model file, field by field."""

    def field(number, data):
        return bytes([number << 3 | 2, len(data)]) + data

    import struct

    body = b""
    for piece, score, kind in spec:
        body += field(1, field(1, piece.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + bytes([3 << 3, kind]))
    return body + field(2, bytes([3 << 3, 1])) + field(3, bytes([4 << 3, 0]))


def test_unigram_takes_the_best_sum():
    spec = [("<unk>", 0, 2), ("▁", -3, 1), ("a", -2, 1), ("b", -2, 1), ("ab", -2.5, 1), ("▁a", -2.2, 1), ("ba", -6, 1)]
    coder = pieces.Coder(pieces.Model(unigram(spec, None)))
    names = [p for p, _, _ in spec]
    assert [[names[i] for i in ids] for ids in coder.encode(["ab", "aab", "b?"])] == [["▁a", "b"], ["▁a", "ab"], ["▁", "b", "<unk>"]]


def test_tables(spark):
    model = pieces.Model.load(MODEL)
    df = spark.createDataFrame([(1, "Hello world", "c"), (2, None, "c"), (3, "", "c")], "doc_id int, text string, ids string")
    out = {r.doc_id: r for r in pieces.decoded(pieces.encoded(df, model), model).collect()}
    assert out[1].decoded == "Hello world" and out[2].ids is None and out[3].ids == [] and out[3].decoded == ""
    rows = {r.doc_id: r for r in pieces.digests(df, model).collect()}
    assert rows[1].round_trip and rows[2].n_tokens is None and rows[3].n_tokens == 0
    assert pieces.digests(df.limit(0), model).count() == 0


def test_units_are_cut_where_no_piece_crosses():
    """Lines of few words must not make as many units as there are pairs of neighbours (round 3, op8_sentencepiece: 915 CPU seconds a GB)."""
    import itertools

    words = ["alpha", "beta", "gamma", "delta", "omega", "theory", "house", "water", "light", "stone", "river", "field"]
    coder = pieces.Coder(pieces.Model.load(MODEL))
    texts = [f"{a}\n{b}\t{c}" for a, b, c in itertools.product(words, repeat=3)]
    ids = coder.encode(texts)
    assert len(coder.units) <= 2 * len(words) + 2
    assert [coder.decode(i) for i in ids] == texts


def test_parts_of_long_texts_and_forgotten_units(both, monkeypatch):
    _, library = both
    texts = [*TEXTS, " ".join(f"w{i}x{i * i}," for i in range(400)), "", "ab" * 700 + " end", "x日\U0001f600y " * 90]
    monkeypatch.setattr(pieces, "_TEXT", 64)
    monkeypatch.setattr(pieces, "_BLOCK", 7)
    monkeypatch.setattr(pieces, "CACHE", 20)
    coder = pieces.Coder(pieces.Model.load(MODEL))
    assert coder.encode(texts) == library.encode(texts)
    ids, starts = coder.flat(texts)
    assert coder.decode_flat(ids, starts) == [coder.decode(i) for i in library.encode(texts)]


def with_bpe(spec):
    return pieces.Model(unigram(spec, None).replace(bytes([2 << 3 | 2, 2, 3 << 3, 1]), bytes([2 << 3 | 2, 2, 3 << 3, 2])))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc▁", min_size=2, max_size=4), max_size=12, unique=True), st.lists(st.text(alphabet="abcd ", max_size=14), min_size=1, max_size=8))
def test_small_models_equal_plain_loops(parts, texts):
    """Merges one by one, and best sums over all cuts; c and the mark occur in pieces without being one."""
    spec = [("<unk>", 0.0, 2), ("a", -0.5, 1), ("b", -0.75, 1), *[(p, -1.0 - i, 1) for i, p in enumerate(parts)]]
    rank = {p: s for p, s, _ in spec[1:]}

    def merged(text):
        now = list(text)
        while True:
            score, at = max(((rank.get(x + y, -1e9), -i) for i, (x, y) in enumerate(zip(now, now[1:], strict=False))), default=(-1e9, 0))
            if score == -1e9:
                return now
            now[-at : 2 - at] = [now[-at] + now[1 - at]]

    def worth(now):
        return sum(rank.get(x, min(s for _, s, _ in spec) - 10.0) for x in now)

    def best(text):
        if not text:
            return 0.0
        return max(worth([text[:k]]) + best(text[k:]) for k in range(1, min(4, len(text)) + 1) if k == 1 or text[:k] in rank)

    names = [p for p, _, _ in spec]
    marked = ["▁" + t.replace(" ", "▁") if t else "" for t in texts]
    model = with_bpe(spec)
    assert model.bpe
    known = [[names.index(x) if x in rank else 0 for x in merged(t)] for t in marked]
    assert pieces.Coder(model).encode(texts) == known
    plain = pieces.Coder(pieces.Model(unigram(spec, None)))
    for t, ids in zip(marked, plain.encode(texts), strict=True):
        assert abs(worth([names[i] if i else "?" for i in ids]) - best(t)) < 1e-6
