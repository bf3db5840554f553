import base64
import hashlib
import random
import struct

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe

PATH = bpe.vocabulary_path()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
OWN = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
V = bpe.vocabulary(PATH)
SIGNS = st.text(st.one_of(st.sampled_from(list("'stmdrevl 　\u00a0\n\tE9²-中あé́😀a\u2028\x00<|")), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(st.lists(SIGNS, min_size=1, max_size=5))
def test_ids_equal_tiktoken(texts):
    for t, (ids, ends) in zip(texts, V.encode(texts)):
        want = OWN.encode_ordinary(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want
        assert V.decode(ids) == t.encode()
        sizes = [len(OWN.decode_single_token_bytes(i)) for i in want]
        assert list(struct.unpack(f"<{len(ends) // 4}I", ends)) == [sum(sizes[:k + 1]) for k in range(len(sizes))]


def test_long_pieces_and_blanks():
    rng = random.Random(1)
    texts = ["a" * 5000, " " * 700 + "x", "\n" * 300, "".join(rng.choice("abc'") for _ in range(4000)), "ab" * 900 + "'ll've'LL", "", "x" * 129]
    for t, (ids, _) in zip(texts, V.encode(texts)):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == OWN.encode_ordinary(t)


def test_query_columns(spark):
    rows = [(1, "Hello world's end", "x"), (2, None, "y"), (2, "", "y"), (None, "日本語 🎉", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.round_trip(df, PATH).select("doc_id", *bpe.digests(bpe.round_trip(df, PATH))).collect()
    want = []
    for i, t, _ in rows:
        ids = OWN.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted([tuple(r) for r in got], key=str) == sorted(want, key=str)
    assert bpe.encode(df.limit(0), PATH).count() == 0
    e = bpe.decode(bpe.encode(df, PATH), PATH)
    assert sorted(bytes(r["decoded"]).decode() for r in e.collect()) == sorted(t or "" for _, t, _ in rows)
