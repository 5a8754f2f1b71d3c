import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from echolattice.llm.tokens import BYTE_BPE_50K, PATTERN, _encoded, certain_cuts, encoder, token_counts, token_ids

pytestmark = pytest.mark.skipif(not os.path.exists(BYTE_BPE_50K), reason="no vocabulary")
HARD = [
    "", " ", "\n\n", "it's 'tis don't x''s 90's 'll \"'s", "a\r\nb\r\n\r\n  c\t\td", "<|endoftext|> <|endoftext|>", "日本語のテキスト、 全角　空白", "é ﬁ  x   y \u0085 z", "a\x1c b\x1f\x00c",
    "\U0001f469\U0001f3fd‍\U0001f52c ok", "=" * 5000, "qzqzxj" * 50, "x = [1,2,\n     3]  # 'note'\n\n\n\ndef f(a):\n\treturn a**2\n" * 30, "ab" * 3000 + " " * 3000 + "c", "".join(chr(i) for i in range(1, 600)),
]


def reference(text):
    """By the published pattern and the merges of a piece, without any cuts."""
    e = encoder(BYTE_BPE_50K, PATTERN)
    return [i for piece in e.pattern.findall(text) for i in e.bpe._encode_single_piece(piece)]


def ids(texts):
    out = []
    for _, rows, flat, counts in _encoded(pa.array(texts, pa.string()), BYTE_BPE_50K, PATTERN):
        ends = np.cumsum(counts)
        assert len(counts) == rows
        out += [flat[e - c : e].tolist() for e, c in zip(ends, counts)]
    return out


def test_hard_texts_one_by_one_and_together():
    want = [reference(t) for t in HARD]
    assert ids(HARD) == want and [ids([t])[0] for t in HARD] == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aZ'st 09\n\r\t.!?_\"é 日é"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_any_text(texts):
    assert ids(texts) == [reference(t) for t in texts]


def test_another_library_agrees():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(os.path.dirname(BYTE_BPE_50K), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    assert [e.ids for e in t.encode_batch(HARD, add_special_tokens=False)] == ids(HARD)


def test_white_space_beyond_the_pattern_engine():
    text = "a" + " \n" * 400_000 + "b"
    assert len(ids([text])[0]) > 1000


SCRIPTS = "абяё漢字かなカナ한국éüßابहिक्ไท😀👩\u200d\u0301\u2009\u00a0\u3000\u0085\u2028\u1680'’st re ll \n\t1٣²½aB.-!…«»_\u200b\ufeff"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=SCRIPTS, max_size=80))
def test_text_of_many_scripts(text):
    assert ids([text]) == [reference(text)]


@pytest.mark.parametrize("word", ["съешь же ещё этих мягких булок ", "東京都渋谷区の天気は晴れです。", "서울의날씨는맑음입니다", "क्षेत्रीय भाषाओं में "])
def test_long_text_of_another_script_is_cut(word):
    enc = encoder(BYTE_BPE_50K, PATTERN)
    seen = []
    plain, enc.distinct = enc.distinct, lambda fragments: (seen.extend(fragments), type(enc).distinct(enc, fragments))[1]
    try:
        assert ids([word * 2000]) == [reference(word * 2000)]
    finally:
        enc.distinct = plain
    assert max(map(len, seen)) < 10 * len(word.encode())


def test_cuts_lie_inside_no_token():
    cuts = certain_cuts([b"ab", b" the", b"\n\n", b"x'"]).reshape(256, 256)
    assert not cuts[ord("a"), ord("b")] and cuts[ord("b"), ord("a")] and not cuts[ord(" "), ord("x")] and cuts[ord("x"), ord("\n")] and not cuts[ord("'"), ord("s")] and not cuts[ord("!"), ord("'")] and not cuts[200:].any()


def test_rows(spark):
    rows = [(1, "hello world"), (2, ""), (3, None), (3, "x"), (4, "y" * 100_000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, text string, n int")
    got = sorted(((r.doc_id, r.ids) for r in token_ids(df, ["doc_id"], "text").collect()), key=str)
    assert got == sorted(((i, reference(t or "")) for i, t in rows), key=str)
    counts = sorted((r.doc_id, r.n_tokens) for r in token_counts(df, ["doc_id"], "text").collect())
    assert counts == sorted((i, len(x)) for i, x in got)
    assert token_ids(df.limit(0), ["doc_id"], "text").count() == 0
