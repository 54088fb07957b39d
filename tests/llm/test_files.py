"""Token files, packing and archives against the libraries and against SQL."""

import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm import packing, queries, token_files, tokenizing, warc
from lamina.llm.tokenizing import ChunkEncoder, public_path


def plain_ids(texts, name, end):
    t = Tokenizer.from_file(public_path(name))
    return {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, end], "<u4") for d, x in texts.items()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(name):
    path = public_path(name)
    t, e = Tokenizer.from_file(path), ChunkEncoder(path)
    cases = [
        "", " ", "  a  b ", "Hello, world!\nA new line.\n\n", "tab\tand  two", "ends with space ", "é Äpfel 😀 x", "don't we'll it's", "a b　c", "1234 5,678.90", "\r\nwin\r\n",
        "<|endoftext|> </s> <unk>", "x" * 3000, "\x00 \x85  ", "'s 's", "ﬁ ligature ½", "名前 は 何", "UPPER lower MiXed", "...!!! ???", "a.b.c d,e", "\n", "\n\n a", " leading",
    ]
    for text, got in zip(cases, e.encode_all(cases), strict=True):
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_codes_come_back():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rnd.integers(0, 1 << 32, n, dtype=np.uint64) >> rnd.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = token_files.encode(ranks)
        assert (token_files.decode(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


def test_token_files(spark, sf_dir, texts):
    want, at = {}, 0
    ids = plain_ids(texts, "byte_bpe_50k.json", 2)
    for d in sorted(ids):
        want[d] = (at, len(ids[d]), zlib.crc32(ids[d].tobytes()))
        at += len(ids[d])
    assert {r[0]: tuple(r[1:4]) for r in queries.op3_token_files(spark, sf_dir).collect()} == want


def test_token_files_of_awkward_rows(awkward, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_IDS", 1000)
    rows = token_files.round_trip(awkward, public_path("byte_bpe_50k.json"), 50_257).collect()
    assert len(rows) == awkward.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[None]["start"] == 0 and by_id[1]["n_tokens"] == by_id[2]["n_tokens"] == 1
    assert token_files.round_trip(awkward.where(F.lit(False)), public_path("byte_bpe_50k.json"), 50_257).count() == 0


def check_packed(rows, size=4096):
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size
    return len(seqs)


def test_packing(spark, sf_dir, texts):
    rows = queries.op7_packing(spark, sf_dir).collect()
    ids = plain_ids(texts, "word_bpe_49k.json", 1)
    want = {(d, k): (at, len(x[at : at + 4096]), zlib.crc32(x[at : at + 4096].tobytes())) for d, x in ids.items() for k, at in enumerate(range(0, len(x), 4096))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    assert len(rows) == len(want)
    least = -(-sum(n for _, n, _ in want.values()) // 4096)
    assert check_packed(rows) <= least * 1.03 + 1


def test_packing_over_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 200)
    rnd = np.random.default_rng(3)
    n = [int(x) for x in rnd.integers(1, 3000, 3000)]
    pieces = spark.createDataFrame([(k, 0, 0, x, 0) for k, x in enumerate(n)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    rows = packing.pack(pieces).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    assert check_packed(rows) <= 1.03 * sum(n) / 4096 + 1


def test_packing_of_awkward_rows(awkward):
    rows = packing.pack(packing.token_pieces(awkward, public_path("word_bpe_49k.json"))).collect()
    check_packed(rows)
    assert sorted(r["length"] for r in rows if r["doc_id"] in (1, 2, 3)) == [1, 1, 1]
    assert sum(r["doc_id"] == 5 for r in rows) == 2 and sum(r["doc_id"] == 7 for r in rows) > 50
    assert packing.pack(packing.token_pieces(awkward.where(F.lit(False)), public_path("word_bpe_49k.json"))).count() == 0


def test_archives_like_sql(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    rel = db.sql(queries.ORACLES["op6_warc"])
    got = queries.op6_warc(spark, sf_dir).select(rel.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rel.fetchall()))


@pytest.fixture(scope="module")
def archive_path(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('warc')}/a"
    big = "x é" * 600
    rows = [(1, "u1", big, 0), (2, "u2", big, 0), (3, None, "small", 0), (4, "u4", "small", 0), (5, "u5", None, 0), (None, "u6", big, 0), (7, "u7", "", 0)]
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string, digest int"), path)
    return path


def test_archive_of_awkward_rows(spark, archive_path):
    got = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.page_records(spark, archive_path).collect()}
    assert got == {1: (2400, "revisit", 2), 2: (2400, "response", None), 3: (5, "response", None), 4: (5, "response", None), 5: (0, "response", None), None: (2400, "revisit", 2), 7: (0, "response", None)}
    empty = archive_path + "-empty"
    warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.page_records(spark, empty).count() == 0


def test_predicates_reach_the_reader(spark, archive_path):
    assert warc.read(spark, archive_path).where("target_uri = 'u4'").select(F.decode("payload", "UTF-8")).first()[0] == "small"
    assert warc.read(spark, archive_path, payload=False).where("warc_type IN ('revisit') AND payload IS NULL").count() == 2
    reader = warc.WarcReader(archive_path, 1 << 20, True)
    from pyspark.sql.datasource import EqualTo, IsNotNull

    left = list(reader.pushFilters([EqualTo(("warc_type",), "revisit"), IsNotNull(("payload",))]))
    assert len(left) == 1 and len(reader.wanted) == 1


def test_foreign_archives(spark, tmp_path):
    import gzip

    def record(kind, uri, body):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{uri}>\r\nWARC-Target-URI: {uri}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    records = [record("response", f"u{k}", b"body%d" % k * (1 + 5000 * (k % 3))) for k in range(20)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc").write_bytes(b"".join(records))
    rows = warc.read(spark, str(tmp_path)).select("target_uri", F.length("payload").alias("n")).collect()
    assert len(rows) == 40
    for r in rows:
        k = int(r["target_uri"][1:])
        assert r["n"] == len(b"body%d" % k) * (1 + 5000 * (k % 3))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_letters_whose_lower_case_is_longer_keep_their_ids_before_signs(name):
    odd = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and len(chr(c).lower()) > 1] + ["ß", "ŉ", "é", "ǰ"]
    texts = [f"{lead}{c}{sign}{tail}" for c in odd for sign in ".,;:!?" for lead in ("", "Bu iş B", "a ") for tail in ("", " Sonra b", "\nb")]
    library = Tokenizer.from_file(public_path(name))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in ChunkEncoder(public_path(name)).encode_all(texts)] == want


def test_whole_words_go_to_the_model_as_bytes():
    """Letters of two alphabets, digits and words that only begin so, at the start of lines and within, against the library; words of letters or digits pass no pre-tokenizer."""
    encoder = ChunkEncoder(public_path("byte_bpe_50k.json"))
    letters = [chr(c) for c in range(0x41, 0x530) if tokenizing._WHOLE.fullmatch(chr(c))]
    words = ["".join(letters[k : k + 5]) for k in range(0, len(letters), 3)] + letters + ["0", "123", "4567890", "12ab", "ab12", "don't", "x×y", "÷", "ª", "naïve", "été,", "слово", "ſ", "ͅa", "á"]
    texts = [" ".join(words), "\n".join(words), "\n\n".join(words[:50]), *words]
    joined = []
    encoder._joined, was = (lambda which, new, by_line=False: (joined.extend(new), was(which, new, by_line))[1]), encoder._joined
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
    assert encoder.by_model and joined and not [w for w in joined if tokenizing._WHOLE.fullmatch(w)]
    assert not ChunkEncoder(public_path("word_bpe_49k.json")).by_model


def test_repeated_words_and_runs_of_signs_are_learnt_once(monkeypatch):
    """Many texts at once: each distinct word goes through the library once, without the signs after it, and letters without pre-tokenizer also where words are lower-cased."""
    signs = ["", ".", "...", "!?", "###", "%%%", "),", "'", "'s", "_", "\x03", "-"]
    words = ["Straße", "слово", "İş", "ab", "AB", "1234", "x1", "été", "ΣΣ", "名前"]
    texts = [f"{w}{s}{tail}" for w in words for s in signs for tail in ("", " b", "\nb", "\n\nb", " " + w)] + ["", " ", "a" + " word, Word" * 200]
    monkeypatch.setattr(tokenizing, "TOGETHER", 2_000)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encoder = ChunkEncoder(public_path(name))
        learnt = []
        encoder._learn = lambda new, was=encoder._learn: (learnt.extend(new), was(new))[1]
        for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
            assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
        assert len(learnt) == len(set(learnt)) and "ab###" not in learnt and "\x01###" in learnt
        assert encoder.by_lower == (name == "word_bpe_49k.json")


def test_the_memory_of_chunks_begins_anew(monkeypatch):
    monkeypatch.setattr(tokenizing, "REMEMBERED", 50)
    monkeypatch.setattr(tokenizing, "KEPT", 10)
    monkeypatch.setattr(tokenizing, "TOGETHER", 100)
    texts = [f"word{k} Wort{k % 7} {k}, end" for k in range(200)] * 2
    encoder = ChunkEncoder(public_path("word_bpe_49k.json"))
    for text, ids in zip(texts, encoder.encode_all(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder.known) < 200
