"""Operators against brute-force versions of their contracts, on small documents."""

import collections
import hashlib
import math
import re
import zlib
from itertools import combinations

import numpy as np
import pytest

from tracemill.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def run(spark, folder, prefix):
    name = next(n for n in queries.QUERIES if n.startswith(prefix))
    return {r.doc_id: r for r in queries.QUERIES[name](spark, folder).collect()}


def shingles(text):
    found = WORD.findall(lower(text))
    return {tuple(found[i : i + 2]) for i in range(len(found) - 1)} if len(found) > 1 else ({tuple(found)} if found else set())


def test_near_duplicates(spark, folder, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in texts}
    for a, b in combinations(texts, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    found = run(spark, folder, "op3_")
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in found.items()} == {i: (len(sets[i]), root[i], root[i] == i) for i in texts}
    assert max(collections.Counter(root.values()).values()) > 15


def test_repeats(spark, folder, texts):
    raw = {i: t.encode() for i, t in texts.items()}
    seen = collections.Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    found = run(spark, folder, "op7_")
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone[:-1]])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        r = found[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())


def test_packing_round_trip(spark, folder, texts):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    name = next(n for n in queries.QUERIES if n.startswith("op6_"))
    pieces, full = collections.defaultdict(list), collections.defaultdict(list)
    for r in queries.QUERIES[name](spark, folder).collect():
        pieces[r.doc_id].append(r)
        full[r.sequence_id].append((r.offset, r.length))
    for i, t in texts.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 2]
        held = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in held] == list(range(len(held))) and sum(r.length for r in held) == len(ids)
        assert len(ids) > 1024 or len(held) == 1
        for r in held:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    for places in full.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024


def test_language_model_base(spark, folder, texts):
    tokens = {i: [*WORD.findall(lower(t)), None] for i, t in texts.items()}
    count = collections.Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(count.values()), len(count)
    found = run(spark, folder, "op10_")
    for i, ws in tokens.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 1) / (n + 1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0


def test_personal_data(spark, folder, texts):
    found = run(spark, folder, "op2_")
    assert set(found) == set(texts)
    i = next(i for i, t in texts.items() if t.startswith("mail bob"))
    r, t = found[i], texts[i]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    held = {"email": "bob@example.com", "ip": "10.1.2.3", "card": "4111 1111 1111 1111", "phone": "+44 20 7946 0958"}
    spans = sorted((t.index(v), k, t.index(v) + len(v)) for k, v in held.items())
    assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def test_fingerprints(spark, folder, texts):
    found, ids = run(spark, folder, "op8_"), sorted(texts)
    for k, i in enumerate(ids):
        t, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        assert (found[i].n_chars, found[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= found[i].near_edited <= 1 and 0 <= found[i].near_next <= 1
    by_text = collections.defaultdict(set)
    for i, t in texts.items():
        by_text[t].add(found[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_toxicity_covers_all_documents(spark, folder, texts):
    found = run(spark, folder, "op9_")
    assert set(found) == set(texts)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())


def test_toxicity_held_out_accuracy(spark):
    """Always answering 0 is right on 0.893 of these rows. Nearly half of the toxic ones hold no word of abuse."""
    import pandas as pd

    data = "/root/testdata/sf0.1"
    frame = pd.read_parquet(f"{data}/labels.parquet").merge(pd.read_parquet(f"{data}/documents.parquet"), on="doc_id")
    toxic, texts = dict(zip(frame.doc_id, frame.toxic)), dict(zip(frame.doc_id, frame.text.fillna("")))
    abuse = re.compile("trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron", re.IGNORECASE)
    found = {i: r.predicted for i, r in run(spark, data, "op9_").items() if r.held_out and i in toxic}
    abusive = [i for i in found if toxic[i] and abuse.search(texts[i])]
    assert len(abusive) > 50 and sum(found[i] for i in abusive) / len(abusive) > 0.95
    flagged = [i for i in found if found[i]]
    assert sum(toxic[i] for i in flagged) / len(flagged) > 0.9
    assert sum(found[i] == toxic[i] for i in found) / len(found) > 0.94


def test_benchmark_passages_are_found(spark, folder, texts):
    name = next(n for n in queries.QUERIES if n.startswith("op1_"))
    held = {r.doc_id for r in queries.QUERIES[name](spark, folder).collect()}
    planted = {i for i, t in texts.items() if t.startswith("start w") or t.endswith(" end")}
    assert planted <= held and len(held) <= len(planted) + 1  # the document that the passage's words were drawn as may be held too


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, "x"), (None, "a b c", None, None, None, "x"), (5, "a b c", "en", "s", 5, "x"), (5, "a b c", "en", "s", 5, "x"), (6, "", "en", "s", 0, "x")]])
def test_pipeline_on_nulls_repeats_clashes_and_empty_tables(spark, tmp_path, rows):
    import corpus_pipeline

    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_lines string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(map(str, [None, None, 5, 6] if rows else []))


def test_pipeline_keeps_clean_documents(spark, folder):
    import corpus_pipeline

    pieces = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in pieces}
    assert len(kept) > 50 and [name for name, _ in corpus_pipeline.STAGES][-1] == "packing"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_documents(spark, folder, tmp_path, name):
    for table in ("documents", "labels", "benchmark"):
        frame = spark.read.parquet(f"{folder}/{table}.parquet")
        (frame.limit(0) if table == "documents" else frame).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
