"""Binary map extracts and posted points, from files and a server made here."""

import json
import struct
import threading
import zlib
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from wayfold.sources import extract, landing
from wayfold.sources.http import posted_answer, posted_records
from wayfold.sources.points import ingest_points

NODES = [(5, 116.1, 39.9, {"barrier": "toll_booth"}), (3, -0.5, -33.25, {}), (2**40, 179.9999999, 0.0, {"name": "é", "k": "v"})]
WAYS = [(7, [5, 3, 2**40, 5], {"highway": "motorway"}), (8, [], {})]
RELATIONS = [(9, [("way", 7), ("node", 5), ("way", 8)], {"type": "route"})]


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def zig(n):
    return varint(n << 1 ^ n >> 63)


def field(number, value):
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def deltas(values):
    return b"".join(zig(b - a) for a, b in zip([0, *values], values, strict=False))


def block(group, texts, grain=100, lat0=0, lng0=0):
    body = field(1, b"".join(field(1, t.encode()) for t in texts)) + field(2, group)
    return body + field(17, grain) + field(19, lat0) + field(20, lng0)


def blob(kind, body, squeeze=True):
    raw = field(2, len(body)) + field(3, zlib.compress(body)) if squeeze else field(1, body)
    head = field(1, kind) + field(3, len(raw))
    return struct.pack(">i", len(head)) + head + raw


def binary(features=("OsmSchema-V0.6", "DenseNodes")):
    texts = [""]

    def t(x):
        if x not in texts:
            texts.append(x)
        return texts.index(x)

    def tags(own):
        return (field(2, b"".join(varint(t(k)) for k in own)) + field(3, b"".join(varint(t(v)) for v in own.values()))) if own else b""

    whole = lambda x: round(x * 1e7)
    dense = field(1, deltas([n[0] for n in NODES])) + field(8, deltas([whole(n[2]) for n in NODES])) + field(9, deltas([whole(n[1]) for n in NODES]))
    dense += field(10, b"".join(b"".join(varint(t(k)) + varint(t(v)) for k, v in n[3].items()) + varint(0) for n in NODES))
    one = varint(1 << 3) + zig(11) + field(2, varint(t("k"))) + field(3, varint(t("v"))) + varint(8 << 3) + zig(400_000) + varint(9 << 3) + zig(-500_000)
    way = lambda w: field(1, w[0]) + tags(w[2]) + (field(8, deltas(w[1])) if w[1] else b"")
    relation = lambda r: field(1, r[0]) + tags(r[2]) + field(8, b"".join(varint(0) for _ in r[1])) + field(9, deltas([m[1] for m in r[1]])) + field(10, b"".join(varint(extract.MEMBER_TYPES.index(m[0])) for m in r[1]))
    groups = [field(2, dense), b"".join(field(3, way(w)) for w in WAYS) + b"".join(field(4, relation(r)) for r in RELATIONS)]
    out = blob(b"OSMHeader", b"".join(field(4, f.encode()) for f in features))
    out += blob(b"OSMData", block(groups[0], texts)) + blob(b"Other", b"skipped") + blob(b"OSMData", block(groups[1], texts), squeeze=False)
    return out + blob(b"OSMData", block(field(1, one), texts, grain=1000, lat0=10**9, lng0=-(10**9)))


def xml():
    tag = lambda own: "".join(f'<tag k="{k}" v="{v}"/>' for k, v in own.items())
    rows = [f'<node id="{i}" lon="{x}" lat="{y}">{tag(own)}</node>' for i, x, y, own in [*NODES, (11, -1.5, 1.4, {"k": "v"})]]
    rows += [f'<way id="{i}">{"".join(f"<nd ref=\"{n}\"/>" for n in refs)}{tag(own)}</way>' for i, refs, own in WAYS]
    rows += [f'<relation id="{i}">{"".join(f"<member type=\"{k}\" ref=\"{r}\" role=\"\"/>" for k, r in members)}{tag(own)}</relation>' for i, members, own in RELATIONS]
    return f"<osm>{''.join(rows)}</osm>"


def test_binary_extract_equals_xml(spark, tmp_path):
    (tmp_path / "a.pbf").write_bytes(binary())
    (tmp_path / "a.xml").write_text(xml())
    found, wanted = extract.read_binary_extract(spark, f"file://{tmp_path}/a.pbf"), landing.read_extract(spark, str(tmp_path / "a.xml"))
    rounded = lambda r: tuple(sorted(x.items()) if isinstance(x, dict) else round(x, 7) if isinstance(x, float) else x for x in r)
    for name in ("nodes", "ways", "relations"):
        assert found[name].columns == wanted[name].columns
        assert sorted(map(rounded, found[name].collect())) == sorted(map(rounded, wanted[name].collect()))
    assert found["nodes"].rdd.getNumPartitions() == 3  # one for each blob of elements


def test_files_that_cannot_be_read_are_errors(spark, tmp_path):
    whole = binary()
    for name, body, said in (("cut", whole[:-3], "cut off"), ("junk", b"\xff" * 50, "no blob header"), ("new", binary(("OsmSchema-V0.6", "HistoricalInformation")), "HistoricalInformation")):
        (tmp_path / name).write_bytes(body)
        with pytest.raises(Exception, match=said):
            extract.read_binary_extract(spark, f"file://{tmp_path}/{name}")["nodes"].collect()


class Answers(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        self.seen.append((self.path, self.headers.get("Accept"), self.headers.get("Content-Length")))
        rows = [{"Id": "a", "Lng": 116.1, "Lat": "39.9", "Address": "x", "CameraType": "k"}]
        body = json.dumps({"data": rows}).encode()
        status, kind, declared = 200, "application/json; charset=utf-8", None
        if self.path == "/moved":
            status = 302
        elif self.path == "/down":
            status = 503
        elif self.path == "/page":
            kind = "text/html"
        elif self.path == "/empty":
            body = b""
        elif self.path in ("/large", "/endless"):
            body, declared = b"[" + b" " * 500_000 + b"]", self.path == "/large"
        self.send_response(status)
        self.send_header("Content-Type", kind)
        if status == 302:
            self.send_header("Location", "/good")
        if declared is not False:
            self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        try:
            self.wfile.write(body)
        except ConnectionError:
            pass

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    made = HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_posted_points(spark, server):
    got = ingest_points(posted_records(spark, f"{server}/good"))
    assert [r["id"] for r in got.valid.collect()] == ["a"]
    assert ("/good", "application/json", "0") in Answers.seen
    row = posted_answer(spark, f"{server}/good").first()
    assert (len(row["sha256"]), row["bytes"]) == (64, len(row["value"]))


@pytest.mark.parametrize(("path", "said"), [("/moved", "status 302"), ("/down", "status 503"), ("/page", "type text/html"), ("/empty", "empty"), ("/large", "over 100000 bytes"), ("/endless", "over 100000 bytes")])
def test_refusals(spark, server, path, said):
    with pytest.raises(Exception, match=said):
        posted_answer(spark, f"{server}{path}", most=100_000).collect()
