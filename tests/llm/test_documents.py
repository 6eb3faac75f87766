"""Licenses, URLs, fingerprints, media and WARC: against plain versions and planted cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from evalweave.llm import fingerprint, licenses, queries, transport, url_filter, warc

RNG = random.Random(5)


def prose(n):
    return " ".join("".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(n))


# licenses


def best_coverage(text, template):
    """The most matched words of any local alignment without a band."""
    a, b = licenses.words_at(template)[0], licenses.words_at(text)[0]
    best = licenses.align(a, b, -len(a), len(b))
    return best[0] / len(a) if best else 0.0


def test_licenses_planted(spark):
    mit, isc = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["ISC"]
    edited_mit = mit.replace("free of charge", "gratis").replace("without restriction, ", "")
    rows = [(1, f"{prose(50)}\n{edited_mit.upper()}\n{prose(30)} {isc}"), (2, None), (3, ""), (4, prose(3000)), (5, "licensed under cc by nc 4.0"), (5, "licensed under cc by nc 4.0"), (6, f"{prose(20000)} Released under the MIT License. {prose(500)}"), (7, "the")]
    found = licenses.scan(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, coverage int")).collect()
    assert sorted((r.doc_id, r.license) for r in found) == [(1, "ISC"), (1, "MIT"), (5, "CC-BY-NC-4.0-notice"), (5, "CC-BY-NC-4.0-notice"), (6, "MIT-notice")]
    texts = dict(rows)
    for r in found:
        piece = texts[r.doc_id][r.start : r.end]
        assert r.coverage >= licenses.LEAST_COVERAGE and r.coverage == pytest.approx(best_coverage(piece, licenses.TEMPLATES[r.license]))


def test_every_license_is_found_after_small_edits(spark):
    rows = []
    for i, text in enumerate(licenses.TEMPLATES.values()):
        words = text.split()
        if len(words) > 15:
            for at in range(7, len(words), 12):
                words[at] = "zzz"
        rows.append((i, prose(20) + " " + " ".join(words) + " " + prose(20)))
    found = {r.doc_id: r.license for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == dict(enumerate(licenses.TEMPLATES))


def test_recall_against_alignment_with_every_template(spark):
    """Words of templates changed, dropped and added at random: what alignment without an index finds is found."""
    rows, names = [(-1, "Released under an MIT License."), (-2, f"{prose(9)} all rights were reserved")], list(licenses.TEMPLATES)
    for i in range(240):
        name = names[i % len(names)]
        words = licenses.TEMPLATES[name].split()
        for _ in range(RNG.randint(0, 1 + len(words) // 8)):
            at = RNG.randrange(len(words))
            words[at : at + RNG.randint(0, 1)] = prose(RNG.randint(0, 1)).split()
            words = words or ["x"]
        rows.append((i, f"{prose(15)} {' '.join(words)} {prose(15)}"))
    found = {(r.doc_id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (-1, "MIT-notice") in found
    want = {(i, names[i % len(names)]) for i, t in rows if i >= 0 and best_coverage(t, licenses.TEMPLATES[names[i % len(names)]]) >= licenses.LEAST_COVERAGE}
    # a notice that a longer template holds is reported as that template
    inside = {(i, n) for i, n in want if any(m != n and (i, m) in found for m in names)}
    assert len(want) > 150 and len(want - inside - found) <= 0.02 * len(want)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_winnowing_guarantee():
    grams = np.array([RNG.randint(0, 9) for _ in range(60)], np.uint64)
    owner = np.repeat([0, 1, 2], [30, 1, 29])
    kept = set(licenses.winnow(grams, owner).tolist())
    for at in range(60 - licenses.WINNOW + 1):
        if owner[at] == owner[at + licenses.WINNOW - 1]:
            assert kept & set(range(at, at + licenses.WINNOW))
    assert 30 in kept


# URLs


def test_globs_against_regular_expressions():
    globs = ["a*b?c**d", "*", "**x", "q" * 70 + "*", "*.com/en/**", "/a**b*"]
    held = url_filter.GlobAutomaton(globs)
    plain = [re.compile("(?s)^" + re.escape(g).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$") for g in globs]
    for _ in range(1500):
        text = "".join(RNG.choice("abcdx/q.") for _ in range(RNG.randint(0, 9))) + RNG.choice(["", "q" * 70, ".com/en/x"])
        assert held.run([text.encode()])[0].tolist() == [bool(p.match(text)) for p in plain]


def test_url_rules(spark):
    hosts, paths = ["com", "Example.com", "a.example.com", "xexample.com", "net", "example.net", "org", "com.org", ""], ["", "/", "/en/", "/en/7x", "/en", "/de/", "/de/81", "/es/é", "/x.com/en/"]
    urls = [None, "", "no scheme/en/", "http://", *(f"http://{h}{p}{t}" for h in hosts for p in paths for t in ("", "?q=/en/", "#f"))] + ["https://example.com/en/" + "7" * 5000]
    df = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(df, queries.URL_RULES).collect()}
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group().lower()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        fits = [r for r in queries.URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best and best.name, best.verdict if best else "allow")


# fingerprints


def test_fingerprints_of_batches_and_alone():
    texts = [prose(RNG.randint(0, 300)).encode() for _ in range(60)] + [b"", b"a", b"ab", b"a" * 5000, b"ab" * 4000]
    together = fingerprint.prints(texts)
    for text, (root, sketch, fine) in zip(texts, together, strict=True):
        (alone,) = fingerprint.prints([text])
        assert alone[0] == root and (alone[1] == sketch).all() and (alone[2] == fine).all()
        again = fingerprint.from_text(fingerprint.as_text(alone))
        assert again[0] == root and (again[1] == sketch).all() and (again[2] == fine).all()
    assert len({p[0] for p in together}) == len(set(texts))


def mixed(z):
    z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
    return z ^ (z >> 31)


def plain_levels(text):
    """The phrase names of every level of one text, symbol by symbol."""
    odd = int(fingerprint._ODD)
    symbols, rounds, levels = list(text), fingerprint.ROUNDS_BYTES, []
    names = [mixed((b + 1) * odd % 2**64) for b in text]
    while symbols and not (levels and len(names) == 1):
        runs = []
        for s, n in zip(symbols, names, strict=True):
            if runs and runs[-1][0] == s:
                runs[-1][2] += 1
            else:
                runs.append([s, n, 1])
        symbols = [s for s, _, _ in runs]
        names = [mixed((n + k * odd) % 2**64) if k > 1 else n for _, n, k in runs]
        labels = symbols
        for _ in range(rounds):
            tossed = []
            for i, x in enumerate(labels):
                differ = x ^ labels[i - 1] if i else 1
                place = (differ & -differ).bit_length() - 1
                tossed.append(2 * place + (x >> place & 1))
            labels = tossed
        cuts = [i for i in range(1, len(labels) - 1) if labels[i] > labels[i - 1] and labels[i] > labels[i + 1]]
        made = []
        for a, b in zip([0, *cuts], [*cuts, len(labels)], strict=True):
            total = sum(names[i] * int(fingerprint._PLACES[i - a]) for i in range(a, b))
            made.append(mixed((total + (b - a) * odd) % 2**64))
        names = symbols = made
        levels.append(made)
        rounds = fingerprint.ROUNDS_NAMES
    return levels


def plain_phrases(text):
    """(root, phrases at the sketch's level, fine phrases if the former are few)."""
    levels = plain_levels(text)
    if not levels:
        return 0, set(), set()
    at = lambda level: levels[min(level, len(levels)) - 1]
    coarse = at(fingerprint.SKETCH_LEVEL)
    return levels[-1][0], set(coarse), set(at(fingerprint.FINE_LEVEL)) if len(coarse) < fingerprint.FEW else set()


PARSED = [b"", b"a", b"ab", b"aa", b"a" * 300, b"ab" * 90, b"abc" * 70 + b"xyz", "é中文".encode() * 20] + [prose(n).encode() for n in (1, 2, 5, 9, 14, 20, 40, 80, 200)]


def test_parse_against_plain_version():
    roots, phrases, fine = fingerprint.parse(PARSED)
    for text, root, own, few in zip(PARSED, roots.tolist(), phrases, fine, strict=True):
        assert (root, set(own.tolist()), set(few.tolist())) == plain_phrases(text), text


def test_likeness_is_the_exact_overlap_of_few_phrases():
    texts = [t for t in PARSED if t] + [t[: len(t) // 2] + PARSED[-3][: len(t) // 2] for t in PARSED if t]
    found = fingerprint.prints(texts)
    plain = [plain_phrases(t) for t in texts]
    compared = 0
    for a, p in zip(found, plain, strict=True):
        for b, q in zip(found, plain, strict=True):
            x, y = (p[2], q[2]) if p[2] and q[2] else (p[1], q[1])
            if max(len(x), len(y)) <= fingerprint.SKETCH:
                compared += 1
                want = 1.0 if p[:2] == q[:2] else 2 * len(x & y) / (len(x) + len(y))
                assert fingerprint.likeness(a, b) == pytest.approx(want, abs=1e-9)
    assert compared > 100


def test_short_texts_that_share_a_half_are_alike():
    rng = random.Random(3)
    near = []
    for _ in range(300):
        text, other = (" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(5, 9))) for _ in range(2))
        half = len(text) // 2
        a, b = fingerprint.prints([text.encode(), (text[: len(text) - half] + other[:half]).encode()])
        near.append(fingerprint.likeness(a, b))
    assert np.median(near) == pytest.approx(0.5, abs=0.15) and sum(x == 0 for x in near) <= 9


def test_equal_substrings_share_phrases():
    inside = prose(400).encode()
    own = set(fingerprint.parse([inside])[1][0].tolist())
    for before in (b"", b"x", b"some words before ", b"1234567"):
        other = set(fingerprint.parse([before + inside + b" end"])[1][0].tolist())
        assert len(own & other) > 0.9 * len(own)


def test_tossed_labels_differ_and_phrases_stay_short():
    symbols = np.random.default_rng(1).integers(0, 255, 5000).astype(np.uint8)
    symbols = symbols[np.concatenate([[True], symbols[1:] != symbols[:-1]])]
    first = np.zeros(len(symbols), bool)
    first[0] = True
    labels = fingerprint.toss(symbols, first, fingerprint.ROUNDS_BYTES)
    assert labels.max() < 6 and (labels[1:] != labels[:-1]).all()


def test_edits_of_all_documents(spark):
    rows = [(i, prose(120)) for i in range(0, 90, 3)] + [(1, None), (2, ""), (50, "é中" * 3000), (91, "x")]
    rows += [(5, rows[0][1])]
    found = {r.doc_id: r for r in fingerprint.fingerprint_edits(spark.createDataFrame([(*r, "f") for r in rows], "doc_id long, text string, fingerprint string").repartition(5)).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    assert len(found) == len(rows)
    for k, (i, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        assert found[i].n_chars == len(text) and found[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert found[i].fingerprint == fingerprint.as_text(fingerprint.prints([text.encode()])[0])
        assert 0 <= found[i].near_next <= 1 and 0 <= found[i].near_edited <= 1
    assert found[5].fingerprint == found[0].fingerprint
    long = [found[i] for i, t in rows if t and len(t) > 300 and i != 50]
    assert np.median([r.near_edited for r in long]) == pytest.approx(0.5, abs=0.12)
    single = fingerprint.fingerprint_edits(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).first()
    assert single.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and single.near_next == 1.0
    assert fingerprint.fingerprint_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# media


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 576 * 32, 576 * 33, 200_000])
def test_transport_round_trip(n):
    payload = transport.padded(RNG.randbytes(n))
    stream = transport.mux(payload)
    assert len(stream) % 188 == 0 and set(stream[::188]) == {0x47}
    found = transport.demux(stream)
    units = len(payload) // 576
    assert found.payload == payload and found.timestamps == [i * transport.TICKS for i in range(units)]
    assert found.random_access == list(range(0, units, transport.TABLES)) and found.table_errors == found.discontinuities == found.damaged == 0


def test_faulty_streams():
    stream = bytearray(transport.mux(transport.padded(RNG.randbytes(60_000))))
    assert transport.demux(bytes(stream[:1880] + stream[2068:])).discontinuities == 1
    assert transport.demux(bytes(stream[:2068] + stream[1880:2068] + stream[2068:])).payload == transport.demux(bytes(stream)).payload
    stream[188 * 30] = 0
    assert transport.demux(bytes(stream)).damaged == 1
    stream[188 * 0 + 10] ^= 1
    assert transport.demux(bytes(stream)).table_errors == 1
    assert transport.demux(b"").payload == b"" and transport.demux(b"xyz").damaged == 1
    assert transport.section_crc(b"123456789") == 0x0376E6E7


def plain_payload(stream):
    """Payload of the media PID, packet by packet, without numpy or the module's tables."""
    out = b""
    for at in range(0, len(stream), 188):
        packet = stream[at : at + 188]
        if (packet[1] & 31) << 8 | packet[2] != 0x0101:
            continue
        data = packet[4 + (packet[4] + 1 if packet[3] & 0x20 else 0) :]
        out += data[9 + data[8] :] if packet[1] & 0x40 else data
    return out


def test_streams_are_read_by_a_plain_reader():
    for n in (0, 10, 5000):
        payload = transport.padded(RNG.randbytes(n))
        assert plain_payload(transport.mux(payload)) == payload


def test_damaged_streams_never_stop_the_reading():
    whole = transport.mux(transport.padded(RNG.randbytes(30_000)))
    for _ in range(300):
        stream = bytearray(whole)
        for _ in range(RNG.randint(1, 40)):
            stream[RNG.randrange(len(stream))] = RNG.randrange(256)
        if RNG.random() < 0.3:
            at = RNG.randrange(len(stream))
            del stream[at : at + RNG.randint(1, 400)]
        transport.streams(bytes(stream))
    for _ in range(100):
        transport.streams(b"".join(b"G" + RNG.randbytes(187) for _ in range(RNG.randint(0, 30))))
    table = bytearray(whole)
    table[3], table[4] = 0x30, 183  # an adaptation field that fills the first table's packet
    assert transport.demux(bytes(table)).payload == transport.demux(whole).payload


def test_units_with_lost_packets_are_listed():
    whole = transport.mux(transport.padded(RNG.randbytes(576 * 20)))
    for packet in range(1, 4):  # of the fourth unit: two tables, then four packets each
        at = 188 * (2 + 3 * 4 + packet)
        assert transport.demux(whole[:at] + whole[at + 188 :]).broken == [3]
    at = 188 * (2 + 3 * 4)
    assert 2 in transport.demux(whole[:at] + whole[at + 188 :]).broken
    assert transport.demux(whole).broken == []
    code = bytearray(whole)
    code[188 * (2 + 4) + 4 + transport.ADAPT + 2] = 9
    assert transport.demux(bytes(code)).broken == [1]


def packets_of(pid, data, start=True):
    """A payload over as many packets as it takes."""
    out = []
    for k, at in enumerate(range(0, len(data), 184)):
        out.append((bytes([0x47, (0x40 if start and not k else 0) | pid >> 8, pid & 255, 0x10 | k % 16]) + data[at : at + 184]).ljust(188, b"\xff"))
    return b"".join(out)


def test_long_tables_and_several_programs():
    pids = list(range(300, 380))
    entries = b"".join(bytes([6]) + (0xE000 | p).to_bytes(2, "big") + b"\xf0\x00" for p in pids)
    pat = transport._section(0, 1, b"".join(x.to_bytes(2, "big") for x in (0, 0xE010, 1, 0xE100, 2, 0xE200)))
    long = transport._section(2, 1, b"\xe1\x00\xf0\x00" + entries)  # over three packets
    short = transport._section(2, 2, b"\xe1\x00\xf0\x00" + bytes([6]) + (0xE000 | 400).to_bytes(2, "big") + b"\xf0\x00")
    media = bytearray(transport.mux(transport.padded(b"x"))[188 * 2 :])
    for at in range(0, len(media), 188):
        media[at + 1], media[at + 2] = media[at + 1] & 0xE0 | 400 >> 8, 400 & 255
    stream = packets_of(0, b"\0" + pat) + packets_of(0x100, b"\0" + long) + packets_of(0x200, b"\0" + short) + bytes(media)
    found = {(x.program, x.pid): x for x in transport.streams(stream)}
    assert set(found) == {(1, p) for p in pids} | {(2, 400)}
    assert found[2, 400].payload == transport.padded(b"x") and found[1, 300].payload == b""


def test_media_of_odd_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert transport.media_digests(docs).count() == 0
    long = spark.createDataFrame([(1, "é" * 400_000), (None, "a")], "doc_id long, text string")
    got = {r.doc_id: r for r in transport.media_digests(long).collect()}
    assert got[1].n_bytes == 800_000 and got[None].payload_bytes == 576
    media = transport.with_media(long).unionByName(spark.createDataFrame([(9, 0, None)], "doc_id long, n_bytes long, media binary"))
    rows = {r.doc_id: r for r in transport.demuxed(media).collect()}
    assert bytes(rows[1].payload) == transport.padded(("é" * 400_000).encode()) and bytes(rows[9].payload) == b""


def test_media_digests(spark):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "é" * 288), (4, "é" * 288)]
    found = transport.media_digests(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, media int")).collect()
    assert len(found) == 5
    for r in found:
        payload = transport.padded((dict(rows)[r.doc_id] or "").encode())
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert r.media_sha256 == hashlib.sha256(transport.mux(payload)).hexdigest()


# WARC


def test_revisits_against_plain_version(spark):
    from pyspark.sql import functions as F

    rows, headers = [], lambda **h: [(k.replace("_", "-"), v) for k, v in h.items()]
    for i in range(400):
        url = RNG.choice([None, "", "http://a.com/x?b=2&a=1&utm_x=3#f", "https://www.A.com:443/x?a=1&b=2", "http://a.com/y", f"http://h{i % 7}.org"])
        kind = RNG.choice(["response", "revisit", "request"])
        ts = RNG.choice([None, *range(60)])
        tag = RNG.choice([{}, {"etag": '"1"'}, {"etag": 'W/"1"'}, {"etag": '"2"'}])
        rows.append((f"r{i:03d}", kind, url, ts, RNG.choice([None, "d1", "d2"]), headers(**tag, date=f"d{i}", content_length=str(i), **RNG.choice([{}, {"last_modified": "m"}]))))
    schema = "record_id string, type string, url string, ts long, digest string, headers array<struct<name:string,value:string>>"
    found = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(rows, schema)).collect()}
    canon = dict(spark.createDataFrame(rows, schema).select("record_id", warc.canonical_url(F.col("url"))).collect())
    assert {canon[r[0]] for r in rows if r[2] and "x?" in r[2]} == {"a.com/x?a=1&b=2"}
    assert set(found) == {r[0] for r in rows if r[1] == "revisit"}
    for rid, kind, _, ts, digest, own in rows:
        if kind != "revisit":
            continue
        earlier = [r for r in rows if r[1] == "response" and canon[rid] and canon[r[0]] == canon[rid] and r[3] is not None and ts is not None and r[3] < ts]
        source = max(earlier, key=lambda r: (r[3], r[0]), default=None)
        verdict = "missing"
        if source:
            a, b = dict(own), dict(source[5])
            pairs = [(a.get("etag", "").removeprefix("W/"), b.get("etag", "").removeprefix("W/")), (a.get("last-modified"), b.get("last-modified")), (digest, source[4])]
            both = [(x, y) for x, y in pairs if x and y]
            verdict = "unvalidated" if not both else "resolved" if both[0][0] == both[0][1] else "mismatch"
        assert (found[rid].verdict, found[rid].source_id) == (verdict, source and source[0])
        if verdict == "resolved":
            merged = dict(source[5]) | {k: v for k, v in own if k in warc.PERMITTED}
            assert found[rid].headers == "\n".join(sorted(f"{k}: {v}" for k, v in merged.items()))


def test_warc_files(spark, tmp_path):
    import gzip

    head = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://a.com/{i}\r\nWARC-Date: 2024-01-01T00:00:0{i}Z\r\nWARC-Record-ID: <u{i}>\r\nContent-Length: 9\r\n\r\nHTTP/1.1 200 OK\r\nETag: \"{i}\"\r\n\r\nbody {i}\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(head.format(i=i).encode()) for i in range(3)))
    found = sorted(warc.read_warc(spark, f"file://{tmp_path}/a.warc.gz").collect(), key=lambda r: r.record_id)
    assert [(r.type, r.url, r.record_id, r.status, r.body.strip()) for r in found] == [("response", f"http://a.com/{i}", f"<u{i}>", 200, f"body {i}") for i in range(3)]
    assert [r.ts for r in found] == [1704067200 + i for i in range(3)]


def test_parsing_keeps_columns_of_any_name(spark):
    page = "WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: http://h/p\r\nWARC-Date: 2024-01-0{day}T00:00:00Z\r\nWARC-Record-ID: {kind}-{day}\r\n\r\nHTTP/1.1 {status} X\r\nETag: \"e\"\r\n\r\nbody"
    rows = [(page.format(kind="response", day=1, status=200), "mine", 7, "p", "w", "dot", "B"), (page.format(kind="revisit", day=2, status=304), "mine", 8, "p", "w", "dot", "B")]
    df = spark.createDataFrame(rows, "warc string, type string, url long, __parts string, __warc string, `a.b` string, BODY string")
    parsed = warc.parse_records(df)
    assert parsed.columns == ["type_", "url_", "__parts", "__warc", "a.b", "BODY_", *warc.PARSED]
    assert {(r["type_"], r["__parts"], r["__warc"], r["a.b"], r["BODY_"], r["url"], r["body"]) for r in parsed.collect()} == {("mine", "p", "w", "dot", "B", "http://h/p", "body")}
    assert [(r.record_id, r.verdict, r.source_id) for r in warc.resolve_revisits(parsed).collect()] == [("revisit-2", "resolved", "response-1")]
    assert warc.parse_records(df.limit(0)).collect() == []


def test_url_filter_of_nothing_and_repeats(spark):
    rules = queries.URL_RULES
    df = spark.createDataFrame([(1, "http://a.example.com/en/7x")] * 3 + [(2, None)], "page_id long, url string")
    assert sorted(tuple(r)[:5] for r in url_filter.filter_urls(df, rules).collect()) == [(1, "a.example.com", "/en/7x", "example.com/en/7", "allow")] * 3 + [(2, "", "", None, "allow")]
    assert url_filter.filter_urls(df.limit(0), rules).collect() == []
