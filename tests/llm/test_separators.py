import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import separators
from pageloom.session import materialize
from tests.llm.odd import no_documents, odd_documents


def plain(ids, separator):
    out, start = [], 0
    for k, x in enumerate(ids):
        if x == separator:
            out.append((len(out), start, k - start, True))
            start = k + 1
    return out + ([(len(out), start, len(ids) - start, False)] if start < len(ids) else [])


@pytest.mark.parametrize("block", [2, 6, 64, 1 << 20])
@pytest.mark.parametrize("width", [2, 4])
def test_scan_against_plain_loop(spark, tmp_path, block, width):
    if block % width:
        block = width
    dice = random.Random(block + width)
    want, names = [], []
    for k, (n, share) in enumerate([(0, 0.5), (1, 1.0), (1, 0.0), (300, 0.1), (257, 0.0), (64, 0.9), (500, 0.01)]):
        ids = [9 if dice.random() < share else dice.randrange(8) for _ in range(n)]
        np.array(ids, {2: np.uint16, 4: np.uint32}[width]).tofile(tmp_path / f"f{k}.bin")
        names.append((f"f{k}.bin",))
        want += [(f"f{k}.bin", *row) for row in plain(ids, 9)]
    files = spark.createDataFrame(names, "file string")
    got = separators.document_lengths(files, str(tmp_path), separator=9, width=width, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_odd_files(spark, tmp_path):
    (tmp_path / "odd.bin").write_bytes(b"abc")
    files = spark.createDataFrame([("odd.bin",)], "file string")
    with pytest.raises(Exception, match="whole number of identifiers"):
        separators.document_lengths(files, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="whole identifiers"):
        separators.document_lengths(files, str(tmp_path), block=3)


def test_counts_are_those_of_the_tokenizer(spark):
    encode = separators.encoder(separators.RANKS).encode_ordinary
    got = separators.token_counts(odd_documents(spark)).collect()
    texts = odd_documents(spark).select("doc_id", "text").collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == sorted((r.doc_id or 0, len(encode(r.text or ""))) for r in texts)
    assert separators.token_counts(no_documents(spark)).count() == 0


def test_files_decode_to_the_texts(spark, tmp_path):
    coder = separators.encoder(separators.RANKS)
    docs = odd_documents(spark).repartition(3)
    index = separators.write_token_files(docs, str(tmp_path), width=4)
    texts = {(r.doc_id, r.text or "") for r in docs.collect()}
    seen = set()
    for file in {r.file for r in index.collect()}:
        ids = np.fromfile(tmp_path / file, np.uint32)
        places = {r.place: r.doc_id for r in index.where(F.col("file") == file).collect()}
        for place, start, n, closed in plain(ids.tolist(), separators.SEPARATOR):
            assert closed
            seen.add((places[place], coder.decode(ids[start:start + n].tolist())))
    assert seen == texts
    assert materialize(index, "again").count() == 11


def test_long_runs_of_white_space(monkeypatch):
    coder = separators.encoder(separators.RANKS)
    dice = random.Random(9)
    for least in (2, 3, 5):
        monkeypatch.setattr(separators, "LONG_RUN", least)
        monkeypatch.setattr(separators, "LONG_RUNS", separators.re.compile(f"{separators.BLANKS}{{{least},}}"))
        for _ in range(3000):
            text = "".join(dice.choices([" ", "  ", "\n", "\t", "\xa0", "\u3000", "a", "'s", "1", "é", "!", "\x1c"], k=dice.randrange(24)))
            assert separators.encoded(coder, text) == coder.encode_ordinary(text), text
    monkeypatch.undo()
    for text in (" " * 1_000_000 + "a", "b" + "\n" * 1_200_000, "a" + " \t" * 600_000 + "b" + " " * 900_000 + "c d"):
        ids = separators.encoded(coder, text)
        assert coder.decode(ids) == text
