import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanlens.llm import token_output
from spanlens.llm.storage import new_folder, open_store
from spanlens.llm.token_output import Encoder, read_shard, tokenize, write_shards

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "   ", "a  b", "a   b", "a \n b", "a\n \nb", "\n\n x", " lead", "trail ", "tab\t x", "it's  we'll 12 3", "nbsp  x  y", "\x1c \x1f z \x85 q", "日本 語 ", "🙂 🙂🙂", "<|endoftext|> x", "²³ ½ x٣", "é a", "word " * 3000, "x" * 5000]


def plain():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def texts(seed):
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\t", "ab", "É", "'s", "1", ".", " ", "ß", "語", "\x1c", "-"]
    return ODD + ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(500)]


def test_units_encode_as_whole_texts(monkeypatch):
    t, e = plain(), Encoder(PATH, 0)
    assert e.by_unit and e.type.itemsize == 2
    want = [t.encode(x, add_special_tokens=False).ids + [0] for x in texts(1)]
    assert [np.frombuffer(b, "<u2").tolist() for b in e.encode(texts(1))] == want
    monkeypatch.setattr(token_output, "TABLE_BYTES", 1100)
    assert [np.frombuffer(b, "<u2").tolist() for b in e.encode(texts(1))] == want


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    t, e = Tokenizer.from_file(path), Encoder(path, 0)
    assert not e.by_unit
    some = ["A b c", "hello  world", ""]
    assert [np.frombuffer(b, e.type).tolist() for b in e.encode(some)] == [t.encode(x, add_special_tokens=False).ids + [0] for x in some]


@pytest.mark.parametrize("shards", [None, 3])
def test_round_trip(spark, shards):
    rows = [(i, x) for i, x in enumerate(texts(2))] + [(None, "no id"), (3, None), (3, "same id"), (3, "same id")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(d, x, 1, "c") for d, x in rows], "doc_id long, text string, start long, n_tokens string")
    folder = new_folder(spark, "tokens")
    if shards:
        manifest = write_shards(docs, folder, PATH, shards=shards)
        got = token_output.read_back(spark, folder, manifest).collect()
    else:
        got = tokenize(docs, folder, PATH).collect()
    t, at, want = plain(), 0, []
    for d, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_index_and_checksums(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    folder = new_folder(spark, "tokens")
    write_shards(docs, folder, PATH, shards=1)
    path = f"{folder}/shard-000000"
    assert [d for d, _ in read_shard(path, [7, 0, 19])] == [7, 0, 19]
    store, inner = open_store(path)
    data = bytearray(open(inner + ".bin", "rb").read())
    data[40] ^= 1
    open(inner + ".bin", "wb").write(data)
    with pytest.raises(ValueError):
        list(read_shard(path))


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokenize(docs, new_folder(spark, "tokens"), PATH).collect() == []
