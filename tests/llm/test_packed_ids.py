"""op9: ids against the tokenizers library, blocks and files against what went in."""

import json
import random
import zlib

import numpy as np
import pytest

from terralog.llm import packed_ids
from terralog.llm.common import table

tokenizers = pytest.importorskip("tokenizers")
PATH = packed_ids.default_path()
SCHEMA = "doc_id long, text string, start string, row int"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def expected(library, rows):
    """Rows in ascending id order, null first; rows of one id in input order."""
    out, start = [], 0
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def result(df):
    rows = df.select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    return sorted(map(tuple, rows), key=lambda r: r[1])


def odd_texts():
    rng = random.Random(9)
    parts = [*"abcXYZ  \t\n\r\x0b\x0c\x1c\x1d\x85\xa0     　.,'’-_09éèß́İſKſΣςſ中국😀", "'s", "'LL", "<|endoftext|>", "ing", "the "]
    return [None, "", " ", "\n", "a" * 3000, "<|startoftext|>", *("".join(rng.choices(parts, k=rng.randrange(80))) for _ in range(1500))]


def test_ids(library):
    own = packed_ids.WordIds(PATH)
    texts = [t or "" for t in odd_texts()]
    for part in (texts, *([t] for t in texts)):
        for text, ids in zip(part, own(part), strict=True):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, text


def test_memory_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(packed_ids, "MOST_WORDS", 4)
    own = packed_ids.WordIds(PATH)
    for text in ("one two three four five six", "seven one eight", "x" * 200 + " one"):
        assert np.frombuffer(own([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(own.known) <= 6 and len(own.older) <= 6 and all(len(w) <= 64 for w in own.known)


def test_each_distinct_chunk_is_cut_once(library, monkeypatch):
    """Whatever number of texts and places it stands in."""
    cut = []

    class Pieces:
        def findall(self, text, real=packed_ids.PIECES):
            cut.append(text)
            return real.findall(text)

    monkeypatch.setattr(packed_ids, "PIECES", Pieces())
    own = packed_ids.WordIds(PATH)
    texts = ["It's word-1 and Word-2,\nword-1 " * 50, "", "plain word-1\x1cö! Ж's word-1"] * 2
    for text, ids in zip(texts, own(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert sorted(filter(None, cut)) == sorted(["it's", "word-1", "word-2,", "word-1\x1cö!"])


def test_texts_beyond_what_is_encoded_at_once(library, monkeypatch):
    monkeypatch.setattr(packed_ids.WordIds, "at_once", 50)
    texts = [t or "" for t in odd_texts()[:300]]
    parts = list(packed_ids.in_parts(packed_ids.pa.array(texts), packed_ids.WordIds.at_once))
    own = packed_ids.WordIds(PATH)
    got = [np.frombuffer(ids, "<u4").tolist() for part in parts for ids in own(part)]
    assert len(parts) > 50
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 1000, 128 * 5000])
@pytest.mark.parametrize("kind", ["small", "large", "equal", "mixed", "edge"])
def test_blocks_round_trip(n, kind):
    rng = np.random.default_rng(n)
    ids = {
        "small": rng.integers(0, 4, n), "large": rng.integers(0, 2**32, n), "equal": np.full(n, 2**32 - 1),
        "mixed": np.where(rng.random(n) < 0.08, rng.integers(0, 2**32, n), rng.integers(1000, 1100, n)),
        "edge": rng.choice([0, 1, 2**31, 2**32 - 1], n),
    }[kind].astype("<u4")
    starts, body = packed_ids.packed(ids)
    assert (packed_ids.unpacked(starts, body, n) == ids).all()
    if n:  # one block alone, by the index
        k = (len(starts) - 1) // 2
        block = body[int(starts[k]) : int(starts[k + 1])]
        want = ids[k * 128 : k * 128 + 128]
        assert (packed_ids.unpacked(np.array([0, len(block)], "<u8"), block, len(want)) == want).all()


def test_outliers_go_to_the_exception_list():
    ids = np.full(128, 1000, "<u4")
    ids[::16] = 49_000
    assert len(packed_ids.packed(ids)[1]) == 6 + 8 * 5  # width 0 and eight exceptions


def test_file_is_checked():
    data = packed_ids.file_bytes([3, None], [2, 1], np.array([7, 8, 9], "<u4"))
    keys, lengths, ids = packed_ids.file_parts(data)
    assert (keys, lengths.tolist(), ids.tolist()) == ([3, None], [2, 1], [7, 8, 9])
    with pytest.raises(ValueError):
        packed_ids.file_parts(data[:-9] + b"x" + data[-8:])


def test_round_trip(spark, library):
    texts = odd_texts()[:150]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [(None, "no id"), (2**60 + 1, "far"), (-5, "low")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA).coalesce(1)
    assert result(packed_ids.round_trip(docs, PATH, 50)) == expected(library, rows)
    assert packed_ids.written(docs, PATH, file_ids=50).count() > 10
    assert packed_ids.round_trip(docs.filter("doc_id = 5000"), PATH).collect() == []


def test_driver_documents(spark, library):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = expected(library, [(r.doc_id, r.text) for r in docs.collect()])
    assert result(packed_ids.round_trip(docs, PATH)) == want


def changed(tmp_path, change):
    """The tokenizer's file with something else in it."""
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    change(spec)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    return str(path)


CHANGES = {
    "no small letters": lambda spec: spec["normalizer"]["normalizers"].pop(),
    "no normalizer": lambda spec: spec.update(normalizer=None),
    "another cut": lambda spec: spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"\S+"),
    "cut short": lambda spec: spec.update(truncation={"direction": "Right", "max_length": 5, "strategy": "LongestFirst", "stride": 0}),
    "a word as special token": lambda spec: spec["added_tokens"][0].update(content="the"),
    "a token that takes blanks": lambda spec: spec["added_tokens"][0].update(lstrip=True, rstrip=True),
}


@pytest.mark.parametrize("name", CHANGES)
def test_other_tokenizers_are_used_whole(tmp_path, name):
    path = changed(tmp_path, CHANGES[name])
    other, ids_of = tokenizers.Tokenizer.from_file(path), packed_ids.tokenizer(path)
    texts = [t or "" for t in odd_texts()[:300]] + ["Hello World", "THE the <|startoftext|> theme"]
    for text, ids in zip(texts, ids_of(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == other.encode(text, add_special_tokens=False).ids, text
    assert type(ids_of) is packed_ids.WholeIds and type(packed_ids.tokenizer(PATH)) is packed_ids.WordIds


def test_another_vocabulary(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = list(enumerate(["Hello World  twice", None, "ünï\n\ncode 😀", ""]))
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)
    assert result(packed_ids.round_trip(docs, path)) == expected(tokenizers.Tokenizer.from_file(path), rows)


def test_random_merges_are_refused(tmp_path):
    with pytest.raises(ValueError, match="random"):
        packed_ids.tokenizer(changed(tmp_path, lambda spec: spec["model"].update(dropout=0.1)))


def test_very_long_texts(spark, library):
    """Longer than what is encoded at once and than a file's ids, in one row and in many words."""
    long = "One word after another, 1234 times. " * 70_000
    assert len(long) > packed_ids.TEXT_AT_ONCE
    rows = [(1, "before"), (2, long), (3, "x" * 20_000), (4, long.replace("O", "Ж")), (5, "after")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], SCHEMA)
    assert result(packed_ids.round_trip(docs, PATH, 1000)) == expected(library, rows)


def test_paths_are_those_of_spark(spark, tmp_path):
    at = packed_ids.qualified(spark, f"{tmp_path}/a b%20c")
    assert at.startswith("file:")
    system, path = packed_ids.opened(at)
    assert path == f"{tmp_path}/a b%20c"
    with system.open_output_stream(path) as out:
        out.write(b"x")
    assert spark.read.format("binaryFile").load(str(tmp_path)).first().content == b"x"
    docs = spark.createDataFrame([(1, "one", "x", 1)], SCHEMA)
    assert packed_ids.written(docs, PATH).first().file.startswith("file:")
