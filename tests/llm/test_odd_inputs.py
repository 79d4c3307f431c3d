"""Odd inputs and given tables that the first tests leave out."""

import hashlib
import json
import math
import os
import random
import struct
import time
import zlib
from collections import Counter

import pytest
import xxhash

from airtrace.llm import decontam, licenses, neardup, queries, secrets, toolcalls
from tests.llm.test_llm import CLASHING, EXTRA, FOLDER, RSA, b64, base7, documents, given, jwt

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
CALL = "conv_id long, turn long, call_id string, parent_id string, name string, arguments string"
RESULT = "conv_id long, turn long, call_id string, content string"


# ---------------------------------------------------------------- 3


def test_arguments_that_no_text_can_hold(spark):
    schema = {"t": {"type": "object", "additionalProperties": False, "properties": {"x": {}}}}
    arguments = [r'{"x":"\ud800"}', r'{"\udfff":1}', '{"x":' + "[" * 900 + "]" * 900 + "}", '{"x":' + "[" * 90_000, '{"x":1e999}', '{"x":"\\u00e9😀"}', "", None,
                 '{"x":"' + "y" * 300_000 + '"}', '{"x":' + "9" * 6000 + "}"]
    calls = spark.createDataFrame([(1, i, f"c{i}", None, "t", a) for i, a in enumerate(arguments)], CALL)
    got = {r.turn: r for r in toolcalls.link_tool_calls(calls, spark.createDataFrame([], RESULT), schema).collect()}
    assert len(got) == len(arguments) and [got[i].valid for i in (0, 1, 4, 5, 6, 7, 8)] == [True, False, False, True, False, False, True]
    assert r'"x":"\ud800"' in got[0].canonical and json.loads(got[0].canonical)["call"]["arguments"] == {"x": "\ud800"}
    assert got[1].problem == r"$.\udfff: not expected" and '"x":"é😀"' in got[5].canonical and len(got[8].canonical) > 300_000
    assert got[3].problem == "$: no JSON" and all(json.loads(r.canonical)["call"]["id"] for r in got.values())


def test_no_calls_and_clashing_names(spark):
    extra = ", ".join((CLASHING, "kind string", "status int", "level string", "place string", "canonical int", "role_ int"))
    more = (*EXTRA, "k", 1, "l", "p", 2, 3)
    calls = spark.createDataFrame([(1, 0, "a", None, "t", "{}", *more)], f"{CALL}, {extra}")
    results = spark.createDataFrame([(1, 1, "a", "ok", *more)], f"{RESULT}, {extra}")
    (row,) = toolcalls.link_tool_calls(calls, results, {"t": {}}).collect()
    assert (row.status, row.kind, row.level, row.place) == ("ok", "call", 0, 0)
    assert toolcalls.link_tool_calls(calls.limit(0), results.limit(0), {}).count() == 0
    assert toolcalls.link_tool_calls(calls.limit(0), results, {}).collect()[0].status == "orphan"
    assert toolcalls.link_tool_calls(calls, results.limit(0), {"t": {}}).collect()[0].status == "no_result"


def test_every_turn_is_in_the_result(spark):
    turns = given(spark, "conversations")
    got = queries.queries()["op3_chat_formatting"](spark, FOLDER).collect()
    others = Counter((r.conv_id, r.turn) for r in turns.where("role not in ('user', 'assistant')").collect())
    assert Counter((r.conv_id, r.turn) for r in got if r.kind == "turn") == others and others
    linked = turns.count() - len(got)  # an answered call takes its answer into its own row
    assert 0 < linked <= sum(r.kind == "call" and r.status in ("ok", "no_parent") for r in got)
    odd = spark.createDataFrame([(1, 0, None, "x"), (1, 1, "tool", None), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    calls, results, rest = toolcalls.replies(odd)
    rows = toolcalls.link_tool_calls(calls, results, toolcalls.REPLY_SCHEMA, rest).collect()
    assert Counter(r.canonical for r in rows) == {'{"content":"x","role":null}': 1, '{"content":null,"role":"tool"}': 1, '{"content":null,"role":null}': 1}


# ---------------------------------------------------------------- 7


def test_secrets_of_given_tables(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = queries.queries()["op7_secret_scan"](spark, folder).collect()
    assert len(got) == len(docs) and sum(r.n_assign + r.n_access + r.n_hex for r in got) > 10
    for r in got:
        spans = base7(docs[r.doc_id])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


@pytest.mark.parametrize("unit", ["MIQAgAAAAgEA", "MIIBAgEAAgEA", "b3BlbnNzaC1rZXktdjEA", "MIIC", "3082", "eyJ", "ey", "a.", "x", "MIIBAgEA\\n", "token", "{\"a\":"])
def test_long_texts_take_no_square_of_time(unit):
    text = unit * (1_000_000 // len(unit)) + ".eyJ9.x"
    start = time.perf_counter()
    secrets.confirmed_spans(text)
    secrets.base_spans(text)
    assert time.perf_counter() - start < 8  # minutes to hours with a square


def plain_keys(text):
    """Where base64 of a key stands in one piece, by trying every start and every length."""
    found = []
    for i in range(len(text)):
        for n in range(40, len(text) - i + 1):
            part = text[i:i + n]
            if not part.isalnum() and not set(part) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
                break
            if n % 4 != 1 and secrets.key_kind(secrets.decoded(part)) and len(secrets.decoded(part)) == n * 3 // 4:
                found.append((secrets.key_kind(secrets.decoded(part)), i, i + n))
                break
    return found


def test_keys_at_every_place_of_a_run():
    from tests.llm.test_llm import der

    key = b64(der(0x30, der(2, b"\1") + der(4, bytes(range(32)))) + b"").rstrip("=")
    deal = random.Random(3)
    for _ in range(25):
        junk = ["".join(deal.choice("MICHabz019+/") for _ in range(deal.randrange(0, 30))) for _ in range(3)]
        text = junk[0] + key + junk[1] + " " + junk[2] + key
        want = plain_keys(text)
        got = [s for s in secrets.confirmed_spans(text) if s[0] == "der"]
        assert {s[:2] for s in want} == {s[:2] for s in got} and len(got) == 2


def test_no_documents(spark):
    none = documents(spark, [])
    assert secrets.scan(none).count() == 0 and secrets.mask_secrets(none).count() == 0
    assert licenses.scan_licenses(none).count() == 0 and neardup.one_of_each(none).count() == 0
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontam.contamination(none, items).count() == 0
    assert decontam.contamination(documents(spark, [(1, "one two")]), items.limit(0)).collect()[0].n_hit == 0


# ---------------------------------------------------------------- 8


def test_shards_of_given_tables(spark):
    """Each document's shard from the definition: the least -ln(draw) over the shards."""

    def shard(doc_id, shards):
        def bid(s):
            # Spark's hash of several columns takes the hash so far as the seed of the next
            h = xxhash.xxh64_intdigest(struct.pack("<i", s), xxhash.xxh64_intdigest(str(doc_id), 42))
            return -math.log(((h >> 12) + 0.5) / 2**52)
        return min(range(shards), key=lambda s: (bid(s), s))

    docs = {r.doc_id: r.text or "" for r in given(spark, "documents").collect()}
    got = queries.queries()["op8_sharding"](spark, FOLDER).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law) for r in got) == Counter(
        (i, len(t.encode()) + 1, zlib.crc32(t.encode()), "key") for i, t in docs.items())
    assert all((r.shard, r.grown_shard) == (shard(r.doc_id, 8), shard(r.doc_id, 9)) for r in got)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


# ---------------------------------------------------------------- near-duplicates


def test_similar_sets_of_very_different_texts_in_one_bucket(spark):
    """Many texts with much in common but not enough, and some pairs among them that are alike."""
    rows = [(i, " ".join([f"s{j}" for j in range(89)] + [f"o{i}x{j}" for j in range(15)])) for i in range(1500)]
    rows += [(5000 + i, rows[i][1] + " tail") for i in range(0, 1500, 300)]
    kept = {r.doc_id for r in neardup.one_of_each(documents(spark, rows)).collect()}
    assert kept == set(range(1500))


def test_tokens_in_dotted_runs():
    token = jwt({"alg": "none"})
    for before, after in (("", ""), ("..", ".."), ("a.b.", ".c"), ("eyJ.", ""), ("x" * 50 + ".", ".y.z")):
        spans = [s for s in secrets.confirmed_spans(before + token + after) if s[0] == "jwt"]
        assert spans and spans[0][1] == len(before)
    assert not secrets.confirmed_spans(b64(RSA)[:40] + ".." + b64(RSA)[40:80])


# ---------------------------------------------------------------- 2


@pytest.mark.parametrize("name", ["MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0-header", "GPL-3.0-header", "Zlib"])
def test_edited_templates_at_every_alignment(name):
    """Thirty words put into the middle and some words changed, at every distance from a block's start."""
    scanner = licenses.scanner(tuple(sorted(licenses.TEMPLATES.items())))
    words = licenses.words_of(licenses.TEMPLATES[name])
    most = 30 if len(words) > 60 else 4
    edited = words[:len(words) // 2] + [f"in{i}" for i in range(most)] + words[len(words) // 2:]
    wanted = scanner.shingles[name]
    assert len(set(licenses.tuples_of(edited)) & wanted) >= 0.8 * len(wanted)
    size = 1 << (len(wanted) - 1).bit_length()
    texts = [" ".join([f"a{i}" for i in range(n)] + edited + ["z"] * (n % 7)) for n in range(size + 1)]
    for n, found in enumerate(scanner.scan_all(texts)):
        assert (name, n, n + len(edited)) in found, (name, n)


def test_licenses_by_brute_force(spark, tmp_path):
    from airtrace.llm.licenses import TEMPLATES, tuples_of, words_of

    (tmp_path / "own").mkdir()
    for i in range(40):
        (tmp_path / "own" / f"L{i}.txt").write_text(" ".join(f"w{i % 5}x{j * (1 + i % 3)}" for j in range(12 + 9 * i)))
    own = licenses.read_templates(spark, str(tmp_path / "own"))
    assert len(own) == 40 and own["L3"].startswith("w3x0 ")
    deal = random.Random(2)
    names = sorted(own)
    texts = [" filler ".join(own[n] for n in deal.sample(names, 3)) for _ in range(30)] + ["", "one", " ".join(own[n] for n in names) * 3]
    docs = documents(spark, list(enumerate(texts)))
    for r in licenses.scan_licenses(docs, own).collect():
        have = set(tuples_of(words_of(texts[r.doc_id])))
        assert set(r.licenses) == {n for n, t in own.items() if len(set(tuples_of(words_of(t))) & have) >= 0.8 * len(set(tuples_of(words_of(t))))}
    assert len(TEMPLATES) >= 11
