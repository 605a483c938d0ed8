import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.data import documents, table
from tessera.llm import bpe

with open(bpe.VOCABULARY, "rb") as f:
    WORDS = bpe.Vocabulary(f.read())


def test_query_equals_encoding_whole_texts(spark):
    docs = documents(spark)
    whole = {r.doc_id: WORDS.encoding.encode_ordinary(r.text) for r in docs.collect()}
    rows = bpe.encode(docs).collect()
    assert {r.doc_id: list(r.tokens) for r in rows} == whole
    assert len(rows) == docs.count() and all(r.exact and r.n_tokens == len(r.tokens) for r in rows)


def test_decoding_gives_the_texts_back(spark):
    docs = documents(spark).unionByName(table(spark, [(-1, None), (-2, ""), (-3, "ß \u0085 \U0001f600")]))
    back = bpe.decode(bpe.encode(docs))
    assert docs.select("doc_id", "text").exceptAll(back).count() == 0 and back.count() == docs.count()


def test_shared_passages_are_exact_in_every_place(spark):
    passage = " ".join(f"w{i * i % 977}x" for i in range(2000))
    rows = [(i, "a" * i + passage + "'" * i + " end") for i in range(40)] + [(99, passage + passage)]
    docs = table(spark, rows).withColumn("tokens", F.lit("taken"))
    got = bpe.encode_documents(docs).collect()
    for r in got:
        assert list(r["tokens_"]) == WORDS.encoding.encode_ordinary(r.text) and r.exact


def test_chunks_depend_on_content_alone():
    rng = np.random.default_rng(1)
    core = rng.integers(97, 123, 60_000, dtype=np.uint8)
    pieces = []
    for lead in (0, 777):
        data = np.concatenate([rng.integers(97, 123, lead, dtype=np.uint8), core])
        b = bpe.cuts(data, np.array([0, len(data)]))[0]
        assert b[0] == 0 and b[-1] == len(data) and b == sorted(set(b))
        pieces.append({data[x:y].tobytes() for x, y in zip(b[:-1], b[1:], strict=True)})
    assert len(pieces[0] & pieces[1]) > 0.9 * len(pieces[0])


TEXT = st.text(st.sampled_from("ab'ltse 1.\n\té\u0085\u00a0\u3000\U0001f600"), max_size=80)


@settings(max_examples=400, deadline=None)
@given(TEXT, st.lists(st.integers(0, 80), max_size=6))
def test_repaired_joins_equal_whole_encoding(text, cuts):
    raw = text.encode()
    chars = np.cumsum([0, *(len(c.encode()) for c in text)])
    at = sorted({int(chars[min(c, len(text))]) for c in cuts})
    shared = [(a, z, WORDS.encode(raw[a:z])) for a, z in zip(at[:-1], at[1:], strict=True) if z > a][::2]
    assert bpe.assemble(raw, np.frombuffer(raw, np.uint8), shared, WORDS).tolist() == WORDS.encoding.encode_ordinary(text)


def test_packed_tokens_come_back():
    for tokens in ([], [1, 2, 3], [70000, 5]):
        x = np.array([t for t in tokens if t < len(WORDS.lengths)], np.uint32)
        assert bpe._unpack(bpe._pack(x), int(WORDS.lengths[x].sum()) if len(x) else 0, WORDS).tolist() == x.tolist()


def test_unknown_tokens_and_cut_characters(spark):
    cut = WORDS.encoding.encode_ordinary("\U0001f600")
    rows = [(1, [10**6]), (2, [-1]), (3, None), (4, []), (5, [None]), (6, cut[:1])]
    got = {r.doc_id: r.text for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, tokens array<int>")).collect()}
    assert got[1] is got[2] is got[3] is got[5] is None and got[4] == "" and (len(cut) == 1 or "\ufffd" in got[6])


def test_vocabularies_of_one_size_are_told_apart(spark, tmp_path):
    import base64

    def file(name, order):
        letters = [bytes((b,)) for b in range(256)]
        letters[97], letters[98] = letters[order], letters[195 - order]
        path = tmp_path / name
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(letters)))
        return str(path)

    docs = table(spark, [(1, "ab")])
    one, two = file("one", 97), file("two", 98)
    assert [list(bpe.encode(docs, v).collect()[0].tokens) for v in (one, two, one)] == [[97, 98], [98, 97], [97, 98]]
