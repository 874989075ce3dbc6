import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerlark.llm.bpe import BpeEncoder
from ledgerlark.llm.queries import op8_token_counts
from ledgerlark.llm.token_counts import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["a  b", "a \n b", "\n\nx", " a", "a ", "", "<|endoftext|> x <|endoftext|>", "it's  we'll\tgo\n", "a\xa0b", "x\r\n y", "\x00 a b", "  ", " \n", "é à　b c", "x\x1c y", " ​ a", "IT'S 12½ ²", "日本 語", "😀 a"]


def test_ids_equal_the_library():
    t, e, short = Tokenizer.from_file(PATH), BpeEncoder(PATH), BpeEncoder(PATH, longest=5)
    for x in [*ODD, " ".join(ODD * 3)]:
        want = t.encode(x, add_special_tokens=False).ids
        assert list(e.ids(x)) == want, x
        assert list(short.ids(x)) == want, x


def test_counts_of_whole_table(spark):
    t = Tokenizer.from_file(PATH)
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").toPandas()
    got = op8_token_counts(spark, d).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    for i, x in zip(docs.doc_id, docs.text):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert (got.n_tokens[i], got.n_bytes[i], got.over_limit[i]) == (n, len((x or "").encode()), n > 512)


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "a b", 6), (2, "", 7), (2, "", 7), (3, "ab " * 100_000, 8)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts(df, PATH).collect()}
    n = len(Tokenizer.from_file(PATH).encode("ab " * 100_000).ids)
    assert got == {(1, 0, 0), (None, 3, 2), (2, 0, 0), (3, 300_000, n)}
    assert token_counts(df.limit(0), PATH).count() == 0


def test_other_files_go_through_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), BpeEncoder(path)
    assert e.tokenizer is not None
    assert np.array_equal(e.ids("Some  Words here"), t.encode("Some  Words here", add_special_tokens=False).ids)
