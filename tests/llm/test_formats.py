"""Chat formatting, WARC packages, pieces, and the pipeline."""

import gzip
import hashlib
import io
import json
import os
import random
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cellgrain.llm import chat, common, piece_lattice, warc
from helpers import SCHEMA, awkward_rows

SF = "/root/testdata/sf0.001"


# ---- chat -----------------------------------------------------------------------------------------------------
HOSTILE = ["\\### Assistant: </turn> ok", "</turn>\n### user: x</turn>", "<|image|>\\", "\\\\</turn", "### ", "", "a:b\\:c", "##" + "# x", None, "😀</turn>é"]


def test_chat_reads_back(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", "sys: </turn>\\", None]), rng.choice(HOSTILE)) for c in (1, 2, None) for t in (0, 1, 1, 2, None, 3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    df = df.withColumn("piece", F.lit("clash"))
    out = chat.format_chats(df).select("*", chat.parse_chat(F.col("formatted")).alias("turns"), chat.unescape(chat.masked_text("formatted", "loss_spans")).alias("loss")).collect()
    assert len(out) == 3
    for r in out:
        held = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == r.conv_id))
        assert [(t.role, t.text) for t in r.turns] == [x[2:] for x in held]
        assert r.loss == "".join(x[3] for x in held if x[2] == "assistant")


def test_chat_parts(spark):
    content = '[{"type":"text","text":"see <|image|>"},{"type":"image","uri":"u1","width":28,"height":15},{"type":"audio","uri":"u2","seconds":1.5},' \
        '{"type":"document","uri":"u3","pages":2},{"type":"video","uri":"u4"},{"type":"note","text":"n"}]'
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", content)], "conv_id long, turn long, role string, text string")
    r = chat.format_chats(df.withColumn("parts", chat.json_parts(F.col("text")))).select("*", chat.placeholders(F.col("formatted")).alias("p")).first()
    assert r.p == ["image", "audio", "document", "file"]
    assert [(a.turn_no, a.part_no, a.type, a.uri, a.tokens) for a in r.attachments] == [
        (1, 1, "image", "u1", 4), (1, 2, "audio", "u2", 38), (1, 3, "document", "u3", 512), (1, 4, "file", "u4", 1)]
    for a in r.attachments:
        assert r.formatted[a.start :].startswith(f"<|{a.type}|>")
    assert r.n_tokens == 1 + 6 + 4 + 38 + 512 + 1 + 1


def test_json_that_is_no_list_of_parts_stays_text(spark):
    part = '[{"type":"text","text":"a"}]'
    texts = [
        "[]", " [ ]", "[1]", "[null]", '["a"]', '[{}]', '[{"name": "x"}]', '[{"type":"fruit","text":"apple"}]', '[{"type":"text"}]', '[{"type":"image"}]',
        '[{"type":"text","text":null}]', '[{"type":"text","text":"a"},{"name":"x"}]', '[{"type":"text","text":"a"},null]', '[{"type":"text","text":"a","score":3}]',
        '[{"type":"image","uri":"u","text":"a cat"}]', '[{"type":"image","uri":"u","width":"wide"}]', '[{"type":"text","text":"a","text":"b"}]', '[{"text":"a"}]',
        part + " and more", part + " [1]", part + ", [1]", part + "] [", part[:-1], f"[{part}]", "[see above]", "{}", "", None,
    ]
    df = spark.createDataFrame([(i, 0, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df.withColumn("parts", chat.json_parts(F.col("text")))).select(
        "*", chat.parse_chat(F.col("formatted")).alias("turns"), chat.unescape(chat.masked_text("formatted", "loss_spans")).alias("loss"),
        chat.pieces_of(F.col("turns")[0]["text"]).alias("n")).collect()
    assert {r.conv_id: (r.turns[0].text, r.loss, len(r.attachments)) for r in out} == {i: (t or "", t or "", 0) for i, t in enumerate(texts)}
    assert all(r.n_tokens == r.n for r in out)
    good = ["\n" + part + " \n", '[{"type":"text","text":""},{"type":"image","uri":"u","width":null}]', '[{"type":"audio","uri":"u","seconds":2},{"type":"document","uri":"v"}]']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good)], "i long, text string").orderBy("i")
    assert [[(p.type, p.text, p.uri) for p in r[0]] for r in df.select(chat.json_parts(F.col("text"))).collect()] == [
        [("text", "a", None)], [("text", "", None), ("image", None, "u")], [("audio", None, "u"), ("document", None, "v")]]


def test_chat_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.col("text")))
    assert chat.format_chats(df).count() == 0


# ---- WARC -----------------------------------------------------------------------------------------------------
def package(names, compress=zipfile.ZIP_STORED):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", compress) as z:
        for name, data in names:
            z.writestr(name, data)
        z.comment = b"a comment PK"
    return held


@pytest.mark.parametrize("limit", [1 << 31, 10])
def test_directories_with_and_without_zip64(monkeypatch, limit):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1 if limit == 10 else 65535)
    names = [("a.txt", b"first" * 20), ("dir/é.bin", b"second" * 30), ("empty", b"")]
    held = package(names)
    assert (b"PK\x06\x06" in held.getvalue()) == (limit == 10)
    members = warc.directory(held, len(held.getvalue()))
    assert [m.name for m in members] == [n for n, _ in names]
    for m, (_, data) in zip(members, names, strict=True):
        at, n = warc.stored_range(held, m)
        assert held.getvalue()[at : at + n] == data


def test_broken_and_compressed_packages():
    with pytest.raises(ValueError):
        warc.directory(io.BytesIO(b"no zip at all"), 13)
    held = package([("a", b"x" * 1000)], zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError):
        warc.stored_range(held, warc.directory(held, len(held.getvalue()))[0])


def test_packages_round_trip(spark, monkeypatch):
    big, other = "<p>é</p>" * 400, "x" * 1000
    rows = [(1, "http://a", big), (2, "http://b\r\nX: y", big), (3, None, big), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"),
            (8, "u", other), (9, "u", other[:-1]), (3, "again", big), (None, "u", big), (10, "u", "\r\n\r\n" + other)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    folder = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    packages = warc.write_packages(warc.with_revisits(pages, 1000), folder)
    got = warc.read_packages(packages).collect()
    assert len(got) == len(rows)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or 0)
    want = [(i, "revisit" if h == big and i != 3 else "response", 3 if h == big and i != 3 else None, len((h or "").encode())) for i, _, h in rows]
    assert sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=order) == sorted(want, key=order)
    texts = {i: h for i, _, h in rows}
    assert all(r.payload.decode() == (texts[r.page_id] or "") for r in got if r.record_type == "response")
    assert all("\r" not in r.url and "\n" not in r.url for r in got)
    assert warc.read_packages(warc.write_packages(warc.with_revisits(pages.limit(0), 1000), folder + "x")).count() == 0


def archive_of(ids):
    """An archive of one record per id, and (offset, length) of each."""
    records = [gzip.compress(warc.record_bytes(i, f"http://{i}", b"x" * i, hashlib.sha1(b"x" * i).hexdigest(), i, None)) for i in ids]
    return b"".join(records), [(sum(map(len, records[:k])), len(r)) for k, r in enumerate(records)]


def test_packages_of_several_archives(spark, tmp_path):
    (a, in_a), (b, in_b), (c, in_c) = archive_of([1, 2, 3]), archive_of([4, 5]), archive_of([6])
    line = lambda name, x: json.dumps({"offset": x[0], "length": x[1], "filename": name})
    first = "\n".join([line("a.warc.gz", x) for x in reversed(in_a)] + [line("archive/b.warc.gz", in_b[0])])
    second = "com,example)/ 2024 " + json.dumps({"offset": str(in_b[1][0]), "length": str(in_b[1][1]), "filename": "b.warc.gz"}) + "\n" + line("a.warc.gz", in_a[0])
    whole = [("archive/", b""), ("archive/a.warc.gz", a), ("archive/b.warc.gz", b), ("indexes/one.jsonl", first.encode()), ("indexes/two.cdxj.gz", gzip.compress(second.encode()))]
    alone = [("archive/only.warc.gz", c), ("indexes/i.jsonl", json.dumps({"offset": 0, "length": in_c[0][1]}).encode())]
    for name, members in (("whole", whole), ("alone", alone)):
        (tmp_path / f"{name}.zip").write_bytes(package(members).getvalue())
    packages = spark.createDataFrame([(f"file://{tmp_path}/{n}.zip",) for n in ("whole", "alone")], "path string")
    assert sorted((r.page_id, r.url, r.payload_bytes) for r in warc.read_packages(packages).collect()) == [(i, f"http://{i}", i) for i in range(1, 7)]
    past = json.dumps({"offset": 1, "length": len(a), "filename": "a.warc.gz"}).encode()
    for broken in (whole[:3], [*whole[:4], ("archive/d.warc.gz", c)], [whole[1], whole[3]], [whole[1], whole[2], alone[1]], [whole[1], ("indexes/i", past)], [whole[1], ("indexes/i", b"1 2")]):
        held = package(broken)
        with pytest.raises(ValueError):
            warc.entries_of(held, len(held.getvalue()))


# ---- pieces ---------------------------------------------------------------------------------------------------
def hostile_texts():
    rng = random.Random(1)
    letters = "abcdefghij   \n\tÉéß中文😀.,!?'\"0123 ▁ﬁ²the ing"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    return texts + ["", "a", " ", "a" * 3000, "thething" * 500, " " * 200 + "x" + " " * 33, "\x00\x7f\x1f", "x▁▁y"] + [t for _, t, *_ in awkward_rows() if t]


def test_pieces_equal_the_library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.MODEL)
    model = piece_lattice.read_model()
    texts = hostile_texts()
    got = piece_lattice.encode_texts(texts, model)
    assert [x.tolist() for x in got] == [sp.encode(t) for t in texts]
    assert [piece_lattice.decode_ids(x, model) for x in got] == [t.replace("▁", " ") for t in texts]


def test_viterbi_finds_the_best_sum():
    pieces = [(3, "▁", -4.0), (4, "a", -3.0), (5, "b", -3.5), (6, "ab", -5.0), (7, "▁a", -4.5), (8, "ba", -4.0), (9, "bab", -9.0), (10, "▁ab", -8.0)]
    import numpy as np

    names = [b" ? ", b"", b""] + [p.replace("▁", " ").encode() for _, p, _ in pieces]
    model = piece_lattice.model_of(pieces, piece_lattice.UNIGRAM, names, np.zeros(256, dtype=np.int32), 0)
    scores = {p.replace("▁", " "): s for _, p, s in pieces}

    def best(word):
        found = [0.0]
        for end in range(1, len(word) + 1):
            found.append(max(found[a] + scores.get(word[a:end], -19.0 if end - a == 1 else -1e9) for a in range(max(0, end - 3), end)))
        return found[-1]

    rng = random.Random(6)
    words = sorted({" " * rng.randint(0, 1) + "".join(rng.choice("abc") for _ in range(rng.randint(1, 9))) for _ in range(200)})
    for word, ids in zip(words, piece_lattice.encode_words(words, model), strict=True):
        path = np.frombuffer(ids, dtype=np.int32)
        assert abs(sum(model.scores[i] if i else -19.0 for i in path) - best(word)) < 1e-9


def test_encode_passes_other_columns(spark):
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    out = piece_lattice.decode(piece_lattice.encode(df)).collect()
    assert all(r.decoded == r.text for r in out) and all(r["_row"]["lang"] == "en" for r in out)
    assert piece_lattice.encode(df.limit(0)).count() == 0


# ---- pipeline -------------------------------------------------------------------------------------------------
def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    os.makedirs(f"{tmp_path}/t")
    df = spark.createDataFrame([(*r, 1) for r in awkward_rows()], SCHEMA + ", n_chars long")
    spark.createDataFrame([(0, "nothing of this is in any of the documents here")], "item_id long, text string").write.parquet(f"{tmp_path}/t/benchmark.parquet")
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, f"{tmp_path}/t")
        assert out.columns == df.columns and out.count() <= docs.count()
        docs = out
    last = corpus_pipeline.STAGES[-1][1](spark, docs, f"{tmp_path}/t")
    assert last.columns == ["doc_id", "token_ids", "n_tokens"] and last.count() == docs.count()
    empty = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, f"{tmp_path}/t").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert 50 < len(rows) < 200 and len({r.doc_id for r in rows}) == len(rows)
