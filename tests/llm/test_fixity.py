"""The fixity audit against a plain comparison of two archives, record by record."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np

from histsearch.llm import fixity

SCHEMA = "page_id long, url string, html string, sha256 string, node int, n long"


def record(url, html):
    body = (html or "").encode()
    return b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: " + (url or "").encode() + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def layout(rows, file_bits):
    """(page_id, digest) -> list of (file, offset, length) of its copies."""
    entries = []
    for page_id, url, html in rows:
        raw = record(url, html)
        mark = hashlib.sha256(b"no id" if page_id is None else f"id {page_id}".encode()).hexdigest()
        entries.append((mark, hashlib.sha256(raw).hexdigest(), page_id, len(raw)))
    at, out = Counter(), defaultdict(list)
    for mark, digest, page_id, n in sorted(entries, key=lambda e: e[:2]):
        file = int(mark[:12], 16) >> (48 - file_bits)
        out[page_id, digest].append((file, at[file], n))
        at[file] += n
    return out


def expected(ours, theirs):
    n = max(len(set(map(tuple, ours))), len(set(map(tuple, theirs))))
    bits = max(0, math.ceil(math.log2(max(1, n / fixity.FILE_RECORDS))))
    a, b = layout(ours, bits), layout(theirs, bits)
    out, over = Counter(), defaultdict(lambda: ([], []))
    for key in set(a) | set(b):
        mine, other = a.get(key, []), b.get(key, [])
        both = min(len(mine), len(other))
        same = bool(both) and mine[0] == other[0]
        for place in mine[:both]:
            out[(key[0], *place, key[1], "ok" if same else "moved")] += 1
        over[key[0]][0].extend((key[1], *p) for p in mine[both:])
        over[key[0]][1].extend((key[1], *p) for p in other[both:])
    for page_id, (mine, other) in over.items():
        for k, (digest, *place) in enumerate(sorted(mine)):
            out[(page_id, *place, digest, "corrupt" if k < len(other) else "missing")] += 1
        for digest, *place in sorted(other)[len(mine) :]:
            out[(page_id, *place, digest, "extra")] += 1
    return out


def audited(spark, ours, theirs):
    make = lambda rows: spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    return Counter((r["page_id"], r["warc"], r["record_offset"], r["record_length"], r["record_sha256"], r["status"]) for r in fixity.audit(make(ours), make(theirs)).collect())


def archive(n, rng):
    rows = [(i, f"http://h/{i}", "x" * int(rng.integers(0, 40)) + str(i)) for i in range(n)]
    return rows + [(None, None, "n"), (None, "u", None), (7, "http://h/7", "again"), (7, "http://h/7", "again"), (8, None, None), (9, "long", "y" * 200_000)]


def test_random_edits(spark, monkeypatch):
    monkeypatch.setattr(fixity, "FANOUT", 4)
    rng = np.random.default_rng(1)
    ours = archive(150, rng)
    theirs = []
    for row in ours:
        kind = rng.integers(20)
        if kind == 0:
            continue
        theirs.append((row[0], row[1], (row[2] or "") + "+") if kind == 1 else (row[0], row[1], "?" + (row[2] or "")[1:]) if kind == 2 else row)
        if kind == 3:
            theirs.append(row if rng.integers(2) else (1000 + len(theirs), row[1], row[2]))
    assert audited(spark, ours, theirs) == expected(ours, theirs)


def statuses(found):
    out = Counter()
    for key, n in found.items():
        out[key[-1]] += n
    return out


def test_damage_is_located(spark):
    """One lost record is one missing, one longer or changed record one corrupt, one more record one extra."""
    ours = archive(1500, np.random.default_rng(3))
    theirs = [r for r in ours if r[0] != 700] + [(5000, "u", "new")]
    theirs = [(r[0], r[1], r[2] + "!!") if r[0] == 900 else (r[0], r[1], "?" + r[2][1:]) if r[0] == 901 else r for r in theirs]
    found = statuses(audited(spark, ours, theirs))
    assert (found["missing"], found["extra"], found["corrupt"]) == (1, 1, 2) and found["moved"] < 3 * 100


def test_equal_and_empty_replicas(spark):
    rows = archive(20, np.random.default_rng(4))
    assert audited(spark, rows, rows) == expected(rows, rows) and set(statuses(expected(rows, rows))) == {"ok"}
    assert statuses(audited(spark, rows, [])) == Counter(missing=len(rows))
    assert statuses(audited(spark, [], rows)) == Counter(extra=len(rows))
    assert audited(spark, [], []) == Counter()


def test_one_id_with_most_rows(spark, monkeypatch):
    """A hot id, as distinct records and as copies, on the way by shuffles."""
    from histsearch.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(fixity, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    ours = [(1, "u", str(i)) for i in range(60)] + [(2, "u", "same")] * 40 + [(i, "u", "z") for i in range(3, 40)]
    theirs = [(1, "u", str(i) + ("!" if i % 9 == 0 else "")) for i in range(58)] + [(2, "u", "same")] * 43 + ours[100:]
    assert audited(spark, ours, theirs) == expected(ours, theirs)
