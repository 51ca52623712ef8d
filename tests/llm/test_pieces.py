"""The codec against the sentencepiece library."""

import hashlib
import random
import time

import numpy as np
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import empty, odd, odd_rows

from lexweave.llm import pieces as P

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=P.model_file())
CODEC = P.Codec(P.Model.load(P.model_file()))


def own(texts):
    ids, at = CODEC.encode(texts)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)], CODEC.decode(ids, at)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" ▁abcdethe\n\t日本é😀\x00<s>0x0A.,"), max_size=80), max_size=5))
def test_any_text(texts):
    ids, decoded = own(texts)
    assert ids == [LIBRARY.encode(t) for t in texts]
    assert decoded == [LIBRARY.decode(x) for x in ids]


def test_long_words_and_runs_of_spaces():
    rng = random.Random(2)
    texts = ["x" * 5000, " " * 3000 + "a", "ab" * 700 + " " * 40 + "z", "".join(rng.choice("abcdef0123/+=ABC") for _ in range(4000))]
    ids, decoded = own(texts)
    assert ids == [LIBRARY.encode(t) for t in texts] and decoded == texts


def one_at_a_time(sym, table):
    """The plain order of merges: always the best pair, the leftmost of equals."""
    sym = list(sym)
    while True:
        pairs = [(*table[k], i) for i in range(len(sym) - 1) if (k := sym[i] << P._SHIFT | sym[i + 1]) in table]
        if not pairs:
            return sym
        _, made, i = min(pairs, key=lambda x: (x[0], x[2]))
        sym[i : i + 2] = [made]


def test_rounds_are_one_merge_at_a_time():
    rng = random.Random(4)
    table = CODEC.pairs()
    words = ["▁" + "".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for letters in ("thereandinof", "aab", "anananbnb", "e0x1", "-=*") for _ in range(100)]
    sym, at = CODEC.merge(words)
    for w, a, b in zip(words, at, at[1:], strict=False):
        assert sym[a:b].tolist() == one_at_a_time(CODEC.char[np.array([ord(c) for c in w])].tolist(), table), w


def test_rounds_with_ranks_that_are_not_monotone():
    """Random tables, in which a merge often opens a better pair."""
    rng = random.Random(6)
    for _ in range(60):
        pieces = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(25)})
        kinds = [P._UNKNOWN, *[P._NORMAL] * (3 + len(pieces))]
        model = P.Model(["<unk>", "a", "b", "c", *pieces], np.array([0, 0, 0, 0, *(-float(rng.randint(1, 12)) for _ in pieces)], np.float32), kinds)
        codec = P.Codec(model)
        table = codec.pairs()
        words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 40))) for _ in range(40)]
        sym, at = codec.merge(words)
        for w, a, b in zip(words, at, at[1:], strict=False):
            assert sym[a:b].tolist() == one_at_a_time(codec.char[np.array([ord(c) for c in w])].tolist(), table), w


def test_words_of_any_length_are_quick():
    rng = random.Random(7)
    texts = ["x" * 200_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(200_000)), "".join(rng.choice("ABCDEFabcdef0123456789+/") for _ in range(200_000))]
    began = time.time()
    ids, _ = own(texts)
    assert time.time() - began < 60
    assert ids == [LIBRARY.encode(t) for t in texts]


def test_decode_of_any_ids():
    rng = random.Random(5)
    for _ in range(500):
        ids = np.array([rng.randrange(0, 300) if rng.random() < 0.7 else rng.randrange(300, 32000) for _ in range(rng.randint(1, 12))])
        assert CODEC.decode(ids, np.array([0, len(ids)]))[0] == LIBRARY.decode(ids.tolist())


def test_query_columns(spark):
    out = {}
    for r in P.digest(P.encode_decode(odd(spark), P.model_file())).collect():
        out.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]))
    want = {}
    for i, t, *_ in odd_rows():
        ids = LIBRARY.encode(t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.setdefault(i, []).append((len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids))))
    assert {k: sorted(v) for k, v in out.items()} == {k: sorted(v) for k, v in want.items()}
    assert P.encode_decode(empty(spark), P.model_file()).count() == 0
