"""Foreign archives, and verdicts by rules and links over several hops."""

import base64
import hashlib

import numpy as np
import pytest

from tessera.llm import urlfilter, warc
from tessera.llm._joins import join_checked


def record(kind, payload, *fields):
    block = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" + payload
    head = "".join(f"{x}\r\n" for x in ("WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{kind}-{len(fields)}-{fields[0] if fields else ''}>", "Content-Type: application/http; msgtype=response", *fields, f"Content-Length: {len(block)}"))
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("name", ["md5", "sha1", "sha256", "sha512"])
def test_digests_of_any_form(name):
    body = b"some payload"
    digest = hashlib.new(name, body).digest()
    b32 = base64.b32encode(digest).decode()
    for value in (digest.hex(), digest.hex().upper(), b32, b32.lower(), b32.rstrip("=")):
        assert warc.has_digest(body, f"{name}:{value}") is True and warc.has_digest(body, f"{name.upper()}: {value} ") is True
        assert warc.has_digest(body + b"x", f"{name}:{value}") is False
    assert warc.has_digest(body, f"sha-256:{hashlib.sha256(body).hexdigest()}") is True
    assert [warc.has_digest(body, x) for x in (None, "", "blake9:abc", "no digest")] == [None] * 4


def test_foreign_archives(spark, tmp_path):
    body = b"<p>hello</p>"
    right = {"hex": f"sha1:{hashlib.sha1(body).hexdigest()}", "wide": f"sha256:{hashlib.sha256(body).hexdigest()}", "own": "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode(), "wrong": f"sha1:{'0' * 40}", "odd": "xx:1"}
    data = b"".join(record("response", body, f"WARC-Target-URI: http://h/{n}", f"WARC-Payload-Digest:\r\n {d[:7]}{d[7:]}") for n, d in right.items())
    data += record("response", body, "WARC-Target-URI: http://h/none")
    (tmp_path / "a.warc").write_bytes(data)
    got = {r.response.target_uri.rsplit("/", 1)[1]: r.payload_ok for r in warc.captures(spark, str(tmp_path)).collect()}
    assert got == {"hex": True, "wide": True, "own": True, "wrong": False, "odd": None, "none": None}


def test_folded_header_lines():
    import io

    data = b"WARC/1.0\r\nWARC-Target-URI: http://h/\r\n\t a\r\n  b\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (header, block), = warc.parse(io.BytesIO(data))
    assert header["warc-target-uri"] == "http://h/ a b" and block == b""


def test_long_columns_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("tessera.llm._joins.BROADCAST_BYTES", 100)
    left = spark.createDataFrame([(1, "a")], "k long, x string")
    for text, want in (("y" * 90, True), ("y" * 200, False)):
        right = spark.createDataFrame([(1, text), (2, None)], "k long, url string")
        plan = join_checked(left, right, "k", "left", wide=("url",))._jdf.queryExecution().analyzed().toString()
        assert ("ResolvedHint" in plan or "broadcast" in plan.lower()) is want


def ranks(hosts, edges, seeds, damping=0.85, rounds=400):
    index = {h: i for i, h in enumerate(hosts)}
    w = np.zeros((len(hosts), len(hosts)))
    for a, b in edges:
        w[index[a], index[b]] += 1
    out = w.sum(axis=1)
    share = np.divide(w, out[:, None], out=np.zeros_like(w), where=out[:, None] > 0)
    s = np.array([seeds[h] for h in hosts], float)
    if not s.sum():
        return s
    s /= s.sum()
    r = s.copy()
    for _ in range(rounds):
        moved = r @ share
        r = (1 - damping) * s + damping * (moved + (1 - moved.sum()) * s)
    return r


@pytest.mark.parametrize("copies", [20])
def test_rules_and_links_over_hops(spark, copies):
    """A chain of six hosts to a blocked one, one to a trusted one, and a random graph; verdicts by numpy. More pages without links change no link's weight."""
    rng = np.random.default_rng(3)
    rules = (("block", "bad.org/"), ("allow", "good.org/"), ("block", "mixed.org/x"))
    hosts = [f"c{i}.net" for i in range(7)] + [f"t{i}.net" for i in range(5)] + [f"r{i}.net" for i in range(25)] + ["bad.org", "good.org", "mixed.org"]
    links = [(f"c{i}.net", f"c{i + 1}.net") for i in range(6)] + [("c6.net", "bad.org")] + [("good.org", "t0.net")] + [(f"t{i}.net", f"t{i + 1}.net") for i in range(4)]
    links += [(hosts[12 + a], hosts[12 + b]) for a, b in rng.integers(0, 28, (60, 2)).tolist() if a != b]
    out = {h: [] for h in hosts}
    for a, b in links:
        out[a].append(b)
    rows = [(h, "/y", "".join(f'<a href="http://{b}/">' for b in out[h])) for h in hosts] + [("mixed.org", "/x1", ""), ("bad.org", "/z", "")]
    rows += [("filler.net", f"/{i}", "") for i in range(40 * copies)]
    pages = spark.createDataFrame([(i, f"http://{h}{p}", html) for i, (h, p, html) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(pages, rules=rules).collect()}
    every = [*hosts, "filler.net"]
    ruled = [next(((v, r) for v, r in rules if h == r.split("/")[0] and p.startswith("/" + r.split("/")[1])), None) for h, p, _ in rows]
    good = {h: sum(x == h and r is not None and r[0] == "allow" for (x, *_), r in zip(rows, ruled)) for h in every}
    bad = {h: sum(x == h and r is not None and r[0] == "block" for (x, *_), r in zip(rows, ruled)) for h in every}
    trust, distrust = ranks(every, links, good), ranks(every, [(b, a) for a, b in links], bad)
    count = {h: sum(x == h for x, *_ in rows) for h in every}
    blocked = {h for h, t, d in zip(every, trust, distrust) if d > t and d > count[h] / len(rows)}
    near = {h for h, t, d in zip(every, trust, distrust) if abs(d - t) < 1e-5 * d or abs(d - count[h] / len(rows)) < 1e-3 * d}
    assert {f"c{i}.net" for i in range(1, 7)} <= blocked and not any(h.startswith("t") for h in blocked)
    for i, ((h, _, _), rule) in enumerate(zip(rows, ruled)):
        if rule:
            assert got[i] == (rule[1], rule[0])
        elif h not in near:
            assert got[i] == (None, "block" if h in blocked else "allow"), h
