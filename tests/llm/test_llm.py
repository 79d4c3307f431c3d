"""The operators against brute force on small fixtures and the smallest tables."""

import base64
import hashlib
import json
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from airtrace.llm import bpe, decontam, licenses, neardup, quality, queries, secrets, sharding, simhash, suffix, toolcalls, vocabulary, warc
from airtrace.llm.common import indexed
from airtrace.llm.components import components

FOLDER = "/root/testdata/sf0.001"
CLASHING = "n_words int, score string, label int, `index` int, `a.b` int"
EXTRA = (1, "x", 2, 3, 4)
LONG = " ".join(f"word{i % 977} über" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards box with five jolly quails near my vault " * 2
ODD = [
    (1, "One two three four five six seven eight nine ten eleven."), (2, None), (3, ""), (4, "  \n\t "), (None, "no id here"),
    (5, LONG), (6, LONG), (7, PASSAGE + "tail"), (8, "head " + PASSAGE), (9, PASSAGE * 3), (9, PASSAGE * 3), (10, "a" * 5000),
    (11, "x" * 99), (12, "ab" * 50), (13, "ÀÉ ÄÖ ΣΑΣ İ one TWO"), (14, "line\nline\n\nline\n"), (15, "a b c a b c a b c"),
]


def documents(spark, rows=ODD):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], f"doc_id long, text string, {CLASHING}")


def rows_of(df, *by):
    return sorted(df.collect(), key=lambda r: tuple((r[b] is None, r[b]) for b in by))


def given(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet")


# ---------------------------------------------------------------- 1


def words1(text):
    text = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def contamination(docs, items):
    windows = {}
    for item, text in items:
        w = words1(text)
        for i in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[i:i + 10]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words1(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(w), len(hit), len(found), digest, bool(hit)))
    return out


@pytest.mark.parametrize("limit", [500_000, 0])
def test_contamination(spark, limit, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_WINDOWS", limit)
    items = [(10, "ONE two three, four five six seven eight nine ten eleven"), (2, "äö σας"), (3, "TWO"), (4, None), (5, "..."),
             (6, "ÄÖ ΣΑΣ"), (6, "ÄÖ ΣΑΣ"), (7, PASSAGE)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(map(tuple, decontam.contamination(documents(spark), bench).collect()))
    assert got == Counter(contamination(ODD, items))


def test_contamination_of_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in given(spark, "documents").collect()]
    items = [(r.item_id, r.text) for r in given(spark, "benchmark").collect()]
    got = queries.queries()["op1_benchmark_decontamination"](spark, FOLDER)
    assert Counter(map(tuple, got.collect())) == Counter(contamination(docs, items))


def test_removal_of_hits(spark):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = documents(spark)
    kept = decontam.remove_documents(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, None, 5, 6, 10, 11, 12, 13, 14, 15}
    cut = {r.doc_id: r.text for r in decontam.remove_spans(docs, bench).collect()}
    assert cut[1] == " eleven." and cut[7] == " tail" and cut[8] == "head " and cut[2] is None and cut[5] == LONG
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.remove_documents(docs, none).count() == len(ODD)


# ---------------------------------------------------------------- 2


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    changed = mit.replace("free of charge", "at no cost").replace("sublicense", "relicense")
    docs = [(1, "lorem ipsum. Released under the MIT License. dolor"), (2, None), (3, "a b"), (4, LONG + " " + changed + " " + LONG),
            (5, mit[:200]), (None, "Released under the GPL License."), (6, licenses.TEMPLATES["ISC"] + " x " * 400 + licenses.TEMPLATES["ISC"])]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, docs)).collect()}
    assert got[1].spans == "MIT-notice:2:7" and got[2].n_licenses == got[3].n_licenses == got[5].n_licenses == got[None].n_licenses == 0
    assert got[4].licenses == ["MIT"] and got[6].n_licenses == 2 and got[6].licenses == ["ISC"]


def test_licenses_of_given_tables(spark):
    wanted = {name: set(licenses.tuples_of(licenses.words_of(t))) for name, t in licenses.TEMPLATES.items()}
    docs = {r.doc_id: r.text for r in given(spark, "documents").collect()}
    got = queries.queries()["op2_license_scan"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        have = set(licenses.tuples_of(licenses.words_of(docs[r.doc_id])))
        assert r.licenses == ",".join(sorted(n for n, w in wanted.items() if len(w & have) >= 0.8 * len(w)))


# ---------------------------------------------------------------- 3


def test_tool_calls(spark):
    schema = {"t": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer", "maximum": 5}}}}
    calls = [
        (1, 0, "a", None, "t", '{"x": 1, "b": [2, null]}'), (1, 2, "b", "a", "t", '{"x": 9}'), (1, 1, "c", "b", "u", "{}"),
        (1, 4, "d", "gone", "t", "no json"), (1, 5, "e", "f", "t", '{"x":1}'), (1, 6, "f", "e", "t", '{"x":1}'),
        (1, 7, "g", "f", "t", '{"x":true}'), (1, 9, "a", None, "t", "{}"), (2, 0, None, None, "t", "{}"), (None, 0, "a", None, "t", None)]
    results = [(1, 1, "a", "ok"), (1, 3, "a", "later"), (1, 3, "zz", "lost"), (1, 3, "b", None)]
    got = toolcalls.link_tool_calls(
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, parent_id string, name string, arguments string"),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), schema)
    got = {(r.conv_id, r.call_id): r for r in got.collect()}
    state = {k[1]: (r.level, r.place, r.status, r.problem) for k, r in got.items() if k[0] == 1}
    assert state["a"] == (0, 0, "ok", None) and state["b"] == (1, 2, "ok", "$.x: out of range")
    assert state["c"] == (2, 3, "no_result", "unknown tool u") and state["d"][:3] == (0, 1, "no_result")
    assert {state[x][:1] + state[x][2:3] for x in "efg"} == {(None, "cycle")} and state["zz"][2] == "orphan"
    assert got[1, "a"].n_calls == 2 and got[2, None].status == "no_id"
    assert got[1, "a"].canonical == (
        '{"call":{"arguments":{"b":[2,null],"x":1},"id":"a","name":"t"},"level":0,"place":0,"result":"ok","status":"ok"}')


def test_every_call_and_result_has_a_row(spark):
    schema = {"t": {"type": "object", "properties": {"x": {"type": "integer", "maximum": 5}}}}
    calls = [
        (1, 0, "a", None, "t", '{"x": 1}'), (1, 2, "a", None, "t", '{"x": 9}'), (1, 2, "a", None, "t", '{"x": 9}'), (1, None, "a", "a", "t", "no"),
        (1, 3, None, None, "t", "{}"), (None, 3, "b", None, "t", "{}"), (2, 0, "b", None, "t", "{}")]
    results = [
        (1, 1, "a", "first"), (1, 4, "a", "second"), (1, 4, "a", "second"), (1, None, "a", None), (1, 5, "z", "lost"), (1, 6, "z", "lost again"),
        (None, 1, "a", "x"), (1, 1, None, "y"), (None, None, None, None)]
    got = toolcalls.link_tool_calls(
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, parent_id string, name string, arguments string"),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"), schema).collect()
    results_linked = sum(json.loads(r.canonical)["result"] is not None for r in got if r.kind == "call")
    assert results_linked == 1 and len(got) == len(calls) + len(results) - results_linked
    assert Counter((r.kind, r.conv_id, r.turn, r.call_id) for r in got) == (
        Counter(("call", *c[:3]) for c in calls) + Counter(("result", *r[:3]) for r in results) - Counter([("result", 1, 1, "a")]))
    assert Counter((r.kind, r.status) for r in got) == {
        ("call", "ok"): 1, ("call", "no_result"): 1, ("call", "duplicate"): 3, ("call", "no_id"): 2,
        ("result", "duplicate"): 3, ("result", "orphan"): 2, ("result", "no_id"): 3}
    checked = Counter((r.turn, r.problem) for r in got if r.kind == "call" and r.status == "duplicate")
    assert checked == {(2, "$.x: out of range"): 2, (None, "$: no JSON"): 1}


def test_tool_calls_of_given_tables(spark):
    turns = {(r.conv_id, r.turn): r for r in given(spark, "conversations").collect()}
    asked = sorted(k for k, r in turns.items() if r.role == "user")
    want = {}
    for conv, turn in asked:
        level, at = 0, turn
        while (conv, at - 2) in turns and turns[conv, at - 2].role == "user":
            level, at = level + 1, at - 2
        answered = (conv, turn + 1) in turns and turns[conv, turn + 1].role == "assistant"
        status = "no_result" if not answered else "no_parent" if level == 0 and turn >= 2 else "ok"
        want[conv, f"{conv}:{turn}"] = (level, status)
    order = {}
    for conv, call in sorted(want, key=lambda k: (k[0], want[k][0], int(k[1].split(":")[1]))):
        order.setdefault(conv, []).append(call)
    got = [r for r in queries.queries()["op3_chat_formatting"](spark, FOLDER).collect() if r.status != "orphan" and r.kind != "turn"]
    assert {(r.conv_id, r.call_id): (r.level, r.status) for r in got} == want
    assert all(order[r.conv_id][r.place] == r.call_id for r in got) and all(r.valid for r in got)


# ---------------------------------------------------------------- 4


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i:i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints, radius=3):
    ids = list(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash_of_given_tables(spark):
    docs = {r.doc_id: fingerprint(r.text) for r in given(spark, "documents").collect()}
    want = linked(docs)
    got = queries.queries()["op4_simhash"](spark, FOLDER).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{docs[i]:016x}", want[i]) for i in docs}


def test_simhash_of_odd_rows(spark):
    got = Counter((r.doc_id, r.fp % 2**64) for r in simhash.near_duplicates(documents(spark)).collect())
    assert got == Counter((i, fingerprint(t)) for i, t in ODD)
    kept = simhash.one_of_each(documents(spark))
    ids = Counter(r.doc_id for r in kept.collect())
    least = {}
    for i, t in sorted(ODD, key=lambda d: (d[0] is None, d[0] or 0)):
        if not any((fingerprint(t) ^ f).bit_count() <= 3 for f in least.values()):
            least[i] = fingerprint(t)
    assert ids == Counter(least.keys())
    assert simhash.one_of_each(documents(spark, [])).count() == 0


@pytest.mark.parametrize("most", [2048, 8])
def test_links_with_split_buckets(spark, most):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**63, 4).tolist()
    points = {c ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for c in centres for _ in range(60)}
    frame = spark.createDataFrame([(simhash.signed(p),) for p in points], "fp long")
    edges = simhash.links(frame, bucket=most)
    labels = {r.node % 2**64: r.label for r in components(edges).collect()}
    want = linked({p: p for p in points})
    groups = {}
    for p in points:
        groups.setdefault(want[p], set()).add(labels.get(p, p))
    assert all(len(g) == 1 for g in groups.values())
    assert len({min(g) for g in groups.values()}) == len(groups)


def test_masks_cover_every_pair_within_the_radius():
    for positions, radius in ((list(range(64)), 3), (list(range(5, 36)), 3), ([1, 4, 9], 3), (list(range(64)), 7)):
        masks = simhash.covering(positions, radius, 1)
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = np.random.default_rng(0)
        for _ in range(300):
            bits = sum(1 << int(b) for b in rng.choice(positions, min(radius, len(positions)), replace=False))
            assert any(not m & bits for m in masks)
    assert min(m.bit_count() for m in simhash.covering(list(range(64)), 7, 64)) >= 20


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7), (5, 4), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 5


def without_repeats(docs):
    """By a table of all 100-byte strings, every row a document of its own; equal ids go by a hash of the text."""
    def order(d):
        h = xxhash.xxh64_intdigest((d[1] or "").encode(), 42) & ((1 << 62) - 1)
        return d[0] is None, d[0] or 0, h

    seen, out = {}, []
    for nth, (i, text) in enumerate(sorted(docs, key=order)):
        data = (text or "").encode()
        hit = np.zeros(len(data), dtype=bool)
        for a in range(len(data) - 99):
            if seen.setdefault(data[a:a + 100], (nth, a)) != (nth, a):
                hit[a:a + 100] = True
        kept = bytes(b for b, h in zip(data, hit) if not h)
        spans = int(hit[:1].sum() + (hit[1:] & ~hit[:-1]).sum())
        out.append((i, len(data), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeats_of_odd_rows(spark):
    rows = [(i, t[:40_000] if t else t) for i, t in ODD]
    got = suffix.remove_repeats(documents(spark, rows))
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got.collect()) == without_repeats(rows)
    assert suffix.remove_repeats(documents(spark, [])).count() == 0


def test_repeats_of_equal_ids_and_without_id(spark):
    same = PASSAGE + "same"
    rows = [(1, same), (1, same), (1, same), (1, "other " + PASSAGE), (2, "short"), (2, "short"), (None, PASSAGE * 2), (None, PASSAGE * 2), (None, same), (None, None),
            (None, None), (2**63 - 1, "last " + PASSAGE), (2**63 - 1, "last " + PASSAGE), (2**63 - 1, same), (0, "x" * 99), (-5, "first " + PASSAGE), (3, None), (3, "")]
    for copies in (1, 40):
        docs = rows + [(1, same)] * copies + [(None, same)] * copies
        for spread in (65_536, 7):
            suffix.SPREAD, before = spread, suffix.SPREAD
            try:
                got = suffix.remove_repeats(documents(spark, docs))
                columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
                assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == without_repeats(docs)
            finally:
                suffix.SPREAD = before
    kept = suffix.remove_repeats(documents(spark, [(1, same), (1, same)]), keep_bytes=True).collect()
    assert sorted(bytes(r.kept) for r in kept) == sorted([b"", suffix_kept(same)])


def suffix_kept(text):
    (row,) = [r for r in without_repeats([(1, text)])]
    data, seen, hit = text.encode(), set(), set()
    for a in range(len(data) - 99):
        if data[a:a + 100] in seen:
            hit.update(range(a, a + 100))
        seen.add(data[a:a + 100])
    kept = bytes(b for i, b in enumerate(data) if i not in hit)
    assert hashlib.sha256(kept).hexdigest() == row[4]
    return kept


def test_repeats_of_given_tables(spark):
    docs = [(r.doc_id, r.text) for r in given(spark, "documents").collect()]
    got = queries.queries()["op5_suffix_array"](spark, FOLDER)
    assert Counter(map(tuple, got.collect())) == without_repeats(docs)


def test_repeats_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 300)
    rng = np.random.default_rng(3)
    parts = ["".join(rng.choice(list("abc "), 130)) for _ in range(6)]
    docs = [(i, "".join(parts[j] for j in rng.integers(0, 6, 4)) + str(i)) for i in range(40)]
    got = suffix.remove_repeats(documents(spark, docs))
    assert Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in got.collect()) == without_repeats(docs)


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_suffix_array(letters):
    rng = np.random.default_rng(letters)
    for n in range(1, 80):
        s = rng.integers(1, letters + 1, n)
        assert suffix.suffix_array(s).tolist() == sorted(range(n), key=lambda i: s[i:].tolist())


# ---------------------------------------------------------------- 6


def records(pages):
    digests = [(i, hashlib.sha1((h or "").encode()).hexdigest(), len((h or "").encode())) for i, _, h in pages]
    last = {}
    for i, d, n in digests:
        if n >= 1000 and i is not None:
            last[d] = max(last.get(d, i), i)
    out = []
    for i, d, n in digests:
        again = d in last and (i is None or i < last[d])
        out.append((i, n, d, "revisit" if again else "response", last[d] if again else None))
    return Counter(out)


PAGES = [(1, "http://a/\r\nX: y", "x" * 1000), (5, None, "x" * 1000), (5, "u", "x" * 1000), (None, "u", "x" * 1000), (2, "u", "x" * 999),
         (3, "u", "x" * 999), (4, "u", None), (6, "ü", "é" * 600 + "\r\n\r\nz"), (None, "n", "y" * 2000), (7, "u", "é" * 600 + "\r\n\r\nz")]


def test_archives_of_odd_pages(spark):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id long, url string, html string, record_type string")
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(map(tuple, got.collect())) == records(PAGES)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_of_given_tables(spark):
    pages = [tuple(r) for r in given(spark, "pages").select("page_id", "url", "html").collect()]
    got = queries.queries()["op6_warc"](spark, FOLDER)
    assert Counter(map(tuple, got.collect())) == records(pages)


def test_payloads_and_small_archives(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    manifest = warc.write_archives(warc.with_revisits(pages), f"file://{tmp_path}", archive_bytes=300)
    assert manifest.count() > 1
    got = {r.page_id: r for r in warc.read_archives(manifest, payloads=True).collect() if r.page_id in (6, 7, 4)}
    assert got[7].payload.decode() == PAGES[7][2] and got[6].payload is None and got[6].refers_to == 7 and got[4].payload == b""


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directories(tmp_path, monkeypatch, wide):
    import zipfile

    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.comment = b"PK none"
        z.writestr("one", b"1" * 50)
        z.writestr("two/ü", b"22" * 40)
        z.writestr("packed", b"3" * 400, compress_type=zipfile.ZIP_DEFLATED)
    data = path.read_bytes()
    assert (b"PK\x06\x06" in data) == wide
    with open(path, "rb") as f:
        found = {m.name: m for m in warc.members(f, len(data))}
        assert warc.read_range(f, warc.data_start(f, found["two/ü"]), found["two/ü"].size) == b"22" * 40
        with pytest.raises(ValueError):
            warc.data_start(f, found["packed"])


# ---------------------------------------------------------------- 7


def der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else b"\x82" + struct.pack(">H", len(body))
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1 + i] * 40)) for i in range(8)))
PUBLIC = der(0x30, der(0x30, der(6, b"\x2a\x86\x48")) + der(3, b"\0" * 64))
SSH = b"openssh-key-v1\0" + b"".join(struct.pack(">I", len(x)) + x for x in (b"none", b"none", b"")) + struct.pack(">I", 1) + b"".join(
    struct.pack(">I", len(x)) + x for x in (b"k" * 51, b"p" * 130))


def b64(x):
    return base64.b64encode(x).decode()


def jwt(head):
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=")
    return part(head) + "." + part({"sub": "me"}) + ".c2lnbmF0dXJl"


def base7(text):
    found = []
    pattern = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [("assign", *m.span()) for m in re.finditer(pattern, text, re.I | re.A) if len(m[2]) >= 6]
    found += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return sorted(found, key=lambda s: (s[1], order[s[0]]))


SECRETS = [
    (1, 'é PASSWORD: "abc123" token=x token = y12345 ' + "f" * 23 + " " + "0" * 24 + " AKIA" + "A" * 16), (2, None), (3, "K" * 3 + "api_Key='" + "z" * 9),
    (4, "AKIA" + "B" * 15 + " AKIAAKIA" + "C" * 12), (5, "key " + b64(RSA) + " end"), (6, b64(PUBLIC)), (7, RSA.hex()), (8, b64(SSH)), (9, jwt({"alg": "none"})),
    (10, jwt({"typ": "none"})), (11, "-----BEGIN RSA PRIVATE KEY-----\n" + re.sub("(.{64})", r"\1\n", b64(RSA)) + "\n-----END RSA PRIVATE KEY-----"),
    (12, b64(RSA[:-5])), (13, b64(b"0" * 90)), (None, "secret:" + "q" * 6), (None, "secret:" + "q" * 6), (14, "toKen=abcdef" + LONG)]


def test_secrets(spark):
    got = secrets.scan(documents(spark, SECRETS)).collect()
    by_id = {r.doc_id: r for r in got}
    for (i, text), r in zip(sorted(SECRETS, key=str), sorted(got, key=lambda r: str((r.doc_id, dict(SECRETS)[r.doc_id])))):
        spans = base7(text or "")
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
    kinds = {i: {s.split(":")[0] for s in by_id[i].spans.split(",")} for i in range(5, 14)}
    assert kinds[5] == {"der"} and kinds[7] == {"hex", "der"} and kinds[8] == {"openssh"} and kinds[9] == {"jwt"} and kinds[11] == {"der"}
    assert all(kinds[i] == {""} for i in (6, 10, 12, 13))
    assert by_id[5].spans == f"der:4:{4 + len(b64(RSA))}"


def wrapped(text, width, by="\n"):
    return by.join(text[i:i + width] for i in range(0, len(text), width))


def test_secrets_in_odd_places():
    token, url = jwt({"alg": "none"}), base64.urlsafe_b64encode
    encrypted = (
        "-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC," + "0A" * 16 + "\n\n" + wrapped(b64(b"\x9d" * 320), 64)
        + "\n-----END RSA PRIVATE KEY-----")
    commented = "-----BEGIN PRIVATE KEY-----\nComment: a, b\n\n" + wrapped(b64(RSA), 64) + "\n-----END PRIVATE KEY-----"
    dashes = der(0x30, der(2, b"\0") + b"".join(der(2, b"\xfb\xff\xbf" * 13) for _ in range(8)))
    assert {"-", "_"} <= set(url(dashes).decode())
    forms = [
        ("der", wrapped(b64(RSA), 64)), ("der", wrapped(b64(RSA), 76, "\r\n")), ("der", wrapped(b64(RSA), 64, "\\n")), ("der", wrapped(b64(RSA), 70, "\n  ")),
        ("openssh", wrapped(b64(SSH), 70)), ("der", url(dashes).decode()), ("openssh", url(SSH).decode()), ("der", wrapped(RSA.hex().upper(), 64)),
        ("openssh", SSH.hex()), ("jwt", token), ("der", encrypted), ("der", commented)]
    for kind, form in forms:
        for before, after in (("", ""), ("key:\n", "\nmore text"), ("word ", " word"), ("host.", " x"), ("customer_session.", ""), ("a.b.c.", "")):
            spans = [s for s in secrets.confirmed_spans(before + form + after) if s[0] != "assign"]
            assert (kind, len(before), len(before) + len(form)) in spans, (kind, before, form[:40])
            assert "[SECRET]" in secrets.masked(before + form + after) and form[:30] not in secrets.masked(before + form + after)
    for glued in ("is", "prefix", "0x", "ab/"):
        assert [s[:2] for s in secrets.confirmed_spans(glued + b64(RSA))] == [("der", len(glued))]
        assert ("der", len(glued)) in [s[:2] for s in secrets.confirmed_spans(glued + RSA.hex())]
    assert [s[:2] for s in secrets.confirmed_spans("id-" + token)] == [("jwt", 3)]
    for clean in (wrapped(b64(PUBLIC), 64), wrapped(b64(RSA[:-5]), 64), "a." + jwt({"typ": "none"}), commented.replace("MI", "NI"), encrypted.replace("DEK-", "D"),
                  b64(b"0" * 900), "MIT MIME\nMEMO\nwords.and.dots " * 50):
        assert not secrets.confirmed_spans(clean)


def test_masking(spark):
    docs = documents(spark, SECRETS).withColumn("n_chars", F.length("text"))
    got = {r.doc_id: r for r in secrets.mask_secrets(docs).collect()}
    assert got[5].text == "key [SECRET] end" and got[5].n_chars == 16 and got[2].text is None and got[6].text == b64(PUBLIC)
    assert got[5].score == "x" and got[5]["a.b"] == 4


# ---------------------------------------------------------------- 8


def test_shards(spark):
    docs = documents(spark, ODD + [(i, f"t{i}") for i in range(100, 1100)] + [(7, "same")] * 50)
    got = sharding.shard_documents(docs).collect()
    texts = docs.collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) > 60
    assert all(r.grown_shard in (r.shard, 8) for r in got) and any(r.grown_shard == 8 for r in got)
    assert len({(r.doc_id, r.shard) for r in got}) == len({r.doc_id for r in got})
    assert sharding.shard_documents(documents(spark, [])).count() == 0


def test_weights_move_rows_to_the_changed_shard_only(spark):
    ids = spark.range(4000)
    before = {r.id: r.shard for r in sharding.assign_shards(ids, F.col("id"), {0: 1, 1: 1, 2: 2}).collect()}
    after = {r.id: r.shard for r in sharding.assign_shards(ids, F.col("id"), {0: 1, 1: 1, 2: 4}).collect()}
    assert all(a == b or b == 2 for a, b in ((before[i], after[i]) for i in before))
    share = Counter(before.values())
    assert abs(share[2] / 4000 - 0.5) < 0.04
    for wrong in ({}, {0: 0.0}, {0: float("inf")}):
        with pytest.raises(ValueError):
            sharding.shard_of(F.col("id"), wrong)


def test_index(spark):
    rows = spark.createDataFrame([(1, i % 7) for i in range(500)] + [(0, 5)], "a int, b int")
    got = sorted(indexed(rows, "a", "b").collect(), key=lambda r: r["index"])
    assert [r["index"] for r in got] == list(range(501)) and [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in got)


# ---------------------------------------------------------------- 9


def base9(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, None), (6, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark)
    got = quality.score(docs, quality.fit(docs, labels, buckets=256))
    assert Counter((r.doc_id, *(r[c] for c in COUNTS)) for r in got.collect()) == Counter((i, *base9(t)) for i, t in ODD)
    kept = quality.filter_quality(docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} <= {"x"}
    empty = documents(spark, [])
    assert quality.filter_quality(empty, labels.limit(0)).count() == 0


def test_quality_of_given_tables(spark):
    docs = {r.doc_id: r.text for r in given(spark, "documents").collect()}
    labels = {r.doc_id: (r.quality, r.toxic) for r in given(spark, "labels").collect()}
    trusted = {i for i, (q, t) in labels.items() if q == 1 and t != 1}
    signed = lambda x: x
    h = lambda b, seed=42: xxhash.xxh64_intdigest(b, seed)

    def grams(text):
        one = [h(w.encode()) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
        two = [h(struct.pack("<Q", b), h(struct.pack("<Q", a))) for a, b in zip(one, one[1:])]
        return [signed(x) % 32768 for x in one + two]

    raw, good = Counter(), Counter()
    for i, t in docs.items():
        raw.update(grams(t))
        good.update(grams(t) if i in trusted else ())
    scale = good.total() / raw.total()
    got = queries.queries()["op9_quality_rules"](spark, FOLDER).collect()
    for r in got:
        g = grams(docs[r.doc_id])
        score = sum(np.log((good[x] + 5) / (raw[x] * scale + 5)) for x in g) / max(len(g), 1)
        assert r.score == pytest.approx(score, abs=1e-5) and tuple(r[c] for c in COUNTS) == base9(docs[r.doc_id])
        assert r.kept == (not r.base_failed and r.score >= -0.075)
    kept = {r.doc_id: r.kept for r in got if not r.base_failed}
    assert all(kept[i] == (q == 1) for i, (q, _) in labels.items() if i in kept)


# ---------------------------------------------------------------- 10


def test_encoding(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary.word_bpe())
    library.no_truncation()
    library.no_padding()
    odd = [(20, "a<|endoftext|>b <|startoftext|>"), (21, "x\x1cy\x85z　w​q"), (22, "it's 'LL don't ²Ⅷ½ 日本語 😀😀!! é ﬁ ǅ"), (23, "!" * 5000 + "z" * 5000)]
    docs = ODD + odd + [(r.doc_id + 100, r.text) for r in given(spark, "documents").collect()]
    got = Counter(map(tuple, bpe.encode_digests(documents(spark, docs), vocabulary.word_bpe()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()))
    want = Counter()
    for i, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert got == want


# ---------------------------------------------------------------- near-duplicates


def five_word_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1))}


def first_of_each(rows):
    """The least id of every component of rows (id, text) whose five-word shingles have a Jaccard similarity of 0.8."""
    sets = [five_word_shingles(t) for _, t in rows]
    up = list(range(len(rows)))
    for x, a in enumerate(sets):
        for y, b in enumerate(sets[:x]):
            if min(len(a), len(b)) * 5 >= max(len(a), len(b)) * 4 and 5 * len(a & b) >= 4 * len(a | b) and up[x] != up[y]:
                low, high = sorted((up[x], up[y]))
                up = [low if u == high else u for u in up]
    groups = {}
    for u, (i, _) in zip(up, rows):
        groups.setdefault(u, []).append((i is None, i or 0))
    return [None if g[0] else g[1] for g in map(min, groups.values())]


def test_near_duplicates_by_jaccard(spark):
    deal = np.random.default_rng(5)
    line = " ".join(f"common{i}" for i in range(30))
    rows = []

    def add(words):
        rows.append((len(rows), " ".join(words)))

    for group in range(12):
        words = [f"w{group}x{i}" for i in deal.integers(0, 400, 120)]
        for _ in range(9):  # a chain of edits: neighbours are alike, the ends are not
            add(words)
            words = list(words)
            for at in deal.integers(0, len(words), int(deal.integers(0, 4))):
                words[at] = f"new{len(rows)}y{at}"
        # much in common, but below the similarity: fingerprints of word pairs link these
        add(words[:96] + [f"z{group}y{i}" for i in range(30)])
        add([*line.split(), *(f"u{group}y{i}" for i in range(8))])
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a b c d"), (204, "A  b c\td"), (205, "a b c e"), (None, line), (206, line)]
    want = Counter(first_of_each(rows))
    assert 24 < want.total() < len(rows)
    docs = documents(spark, rows)
    got = corpus_pipeline.near_dedup(spark, docs, FOLDER)
    assert got.columns == docs.columns and Counter(r.doc_id for r in got.collect()) == want
    assert corpus_pipeline.near_dedup(spark, documents(spark, []), FOLDER).count() == 0


def edited_copies(n, seed=3):
    """Copies of one text, each with edits of its own, and a line that many have."""
    deal = np.random.default_rng(seed)
    base = [f"w{i}" for i in deal.integers(0, 5000, 140)]
    rows = []
    for i in range(n):
        words = list(base)
        for at in deal.integers(0, len(words), int(deal.integers(0, 8))):
            words[at] = f"e{i}x{at}" if deal.integers(3) else f"e{at}"
        rows.append((i, " ".join(words)))
    return rows


def test_near_dedup_goes_through_the_covering_tables(spark, monkeypatch):
    """All documents are fingerprinted, the tables' links are among the pairs that are confirmed."""
    rows = edited_copies(60)
    wide = [neardup.shingle_set(t) for _, t in rows]
    want = {simhash.signed(simhash.fingerprint(t, shingle=5, distinct=True)) for _, t in rows}
    seen, tried = {}, []
    links, confirmed = simhash.links, neardup.confirmed

    def spy_links(points, *more, **named):
        seen["points"] = {r.fp for r in points.collect()}
        found = links(points, *more, **named)
        seen["links"] = {(r.a, r.b) for r in found.collect()}
        return found

    def spy_confirmed(pairs, *more):
        tried.append({(r.a, r.b) for r in pairs.collect()})
        return confirmed(pairs, *more)

    monkeypatch.setattr(simhash, "links", spy_links)
    monkeypatch.setattr(neardup, "confirmed", spy_confirmed)
    got = Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), FOLDER).collect())
    assert got == Counter(first_of_each(rows))
    assert seen["points"] == want and seen["links"]
    fp = {neardup.signature(s): simhash.signed(simhash.majority(s)) for s in wide}
    known = {tuple(sorted((fp[a], fp[b]))) for a, b in tried[0]}
    assert {tuple(sorted(p)) for p in seen["links"]} <= known


@pytest.mark.parametrize("paired", [4, 32])
def test_edited_copies_are_not_paired_with_each_other(spark, monkeypatch, paired):
    """400 copies of one text, most of them less similar than 0.8 to each other: the pairs compared stay few per copy."""
    rows = edited_copies(400, seed=8)
    pairs, confirmed = [], neardup.confirmed

    def counted(found, *more):
        found = found.distinct()
        pairs.append(found.count())
        return confirmed(found, *more)

    monkeypatch.setattr(neardup, "confirmed", counted)
    monkeypatch.setattr(neardup, "PAIRED", paired, raising=False)
    got = Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), FOLDER).collect())
    want = Counter(first_of_each(rows))
    assert got == want and 20 < want.total() < len(rows)
    assert sum(pairs) < 8 * len(rows), pairs


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    docs = {r.doc_id: r for r in given(spark, "documents").collect()}
    kept9 = {r.doc_id for r in queries.queries()["op9_quality_rules"](spark, FOLDER).collect() if r.kept}
    kept4 = set(first_of_each([(i, docs[i].text) for i in sorted(kept9)]))
    items = [(r.item_id, r.text) for r in given(spark, "benchmark").collect()]
    kept1 = {r[0] for r in contamination([(i, docs[i].text) for i in kept4], items) if not r[5]}
    coder = bpe.encoder(vocabulary.word_bpe())
    want = {i: hashlib.sha256(coder.encode(secrets.masked(docs[i].text))).hexdigest() for i in kept1}
    assert len(want) < len(kept4) < len(kept9) < len(docs)
    got = corpus_pipeline.run(spark, FOLDER)
    assert {r.doc_id: r.ids_sha256 for r in got.collect()} == want
