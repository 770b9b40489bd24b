import random
import zlib

import numpy as np
import pytest
from clauselight.llm import token_files, tokens
from tokenizers import Tokenizer

ODD = [
    None, "", " a", "a ", "a  b", "\n\nx", "x\t\ty z", "é ñ", "don't  'll we'll", "x<|endoftext|>y",
    "a\0b c", "日本語 テスト", "á b", "²³ x1y2", "a\r\nb", "it''s", "a's,b 's", "ab,,", "ab ,,c",
    "x\x1cy \x1c z", "٣٤ a٣", "a​b ​ c", "same", "same",
]


LIBRARY = Tokenizer.from_file(tokens.DEFAULT_TOKENIZER)


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_chunks_encode_like_whole_texts():
    random.seed(1)
    alphabet = "ab é,.'\n\t _-1٣² ́\x1c日!sdmtl"
    assert len(plain("hello <|endoftext|> world")) == 4
    texts = ["".join(random.choices(alphabet, k=random.randint(1, 14))) for _ in range(5000)]
    encode = tokens.encoder(tokens.DEFAULT_TOKENIZER).encode
    for text in [*texts, *ODD]:
        assert encode(text) == np.array(plain(text), "<u4").tobytes(), repr(text)


@pytest.fixture(scope="module")
def documents(spark):
    long = " ".join(f"word{i}" for i in range(9000))
    rows = [(i * 7 % 26, t, "x", i) for i, t in enumerate([*ODD, long])]
    return spark.createDataFrame(rows, "doc_id long, text string, file string, at long")


def test_every_document_is_read_back(spark, documents, tmp_path):
    found = token_files.token_table(spark, documents, str(tmp_path / "f"), length=64).collect()
    at = 0
    rows = sorted(documents.collect(), key=lambda r: (r.doc_id, r.text is not None, r.text or ""))
    for row, got in zip(rows, sorted(found, key=lambda r: r.start), strict=True):
        ids = np.array([*plain(row.text), 2], "<u4")
        assert (got.doc_id, got.start, got.n_tokens) == (row.doc_id, at, len(ids))
        assert got.ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)


def test_sequences_are_views_of_equal_length(spark, documents, tmp_path):
    index = token_files.write(documents, str(tmp_path / "f"), length=64)
    for file in {r.file for r in index.collect()}:
        reader = token_files.SequenceReader(file)
        rows = index.filter(index.file == file).orderBy("row_no").collect()
        n = sum(r.n_tokens for r in rows)
        parts = [reader.sequence(i) for i in range(-(-n // 64))]
        assert {len(ids) for ids, _ in parts} == {64} and not parts[0][0].flags.owndata
        mask = np.concatenate([m.to_numpy(zero_copy_only=False) for _, m in parts])
        assert mask.sum() == n and mask[:n].all()
        ids = np.concatenate([i for i, _ in parts])[mask]
        want = [x for r in rows for v in reader.pieces(r.at, r.n_tokens) for x in v]
        assert ids.tolist() == want


def test_no_documents(spark, documents, tmp_path):
    none = documents.filter("false")
    assert token_files.token_table(spark, none, str(tmp_path / "f")).count() == 0
