"""PBF files that the tests write, read back in one split and in many."""

import random
import zlib

import numpy as np
import pytest

from tramline.sources import osm, pbf


def varint(x):
    x &= (1 << 64) - 1
    out = b""
    while x > 127:
        out += bytes([x & 127 | 128])
        x >>= 7
    return out + bytes([x])


def zig(x):
    return (x << 1) ^ (x >> 63) if x >= 0 else ((-x) << 1) - 1


def field(k, v):
    return varint(k << 3 | 2) + varint(len(v)) + v if isinstance(v, bytes) else varint(k << 3) + varint(v)


def packed(values):
    return b"".join(map(varint, values))


def delta(values):
    return packed(zig(b - a) for a, b in zip([0, *values[:-1]], values, strict=True))


class Strings(list):
    def at(self, s):
        s = s.encode()
        if s not in self:
            self.append(s)
        return self.index(s)


def block(nodes=(), single=(), ways=(), relations=(), grain=100, base=(0, 0)):
    """nodes, single: (id, lon, lat, tags) with places in units of ``grain``; ways: (id, refs, tags); relations: (id, members, tags)."""
    s, groups = Strings([b""]), []
    tags = lambda t: field(2, packed(s.at(k) for k in t)) + field(3, packed(s.at(v) for v in t.values()))
    if nodes:
        flat = [x for n in nodes for x in ([y for k, v in n[3].items() for y in (s.at(k), s.at(v))] + [0])]
        dense = field(1, delta([n[0] for n in nodes])) + field(8, delta([n[2] for n in nodes])) + field(9, delta([n[1] for n in nodes]))
        groups.append(field(2, dense + (field(10, packed(flat)) if any(flat) else b"")))
    if single:
        groups.append(b"".join(field(1, field(1, zig(i)) + tags(t) + field(8, zig(lat)) + field(9, zig(lon))) for i, lon, lat, t in single))
    if ways:
        groups.append(b"".join(field(3, field(1, i) + tags(t) + field(8, delta(refs))) for i, refs, t in ways))
    if relations:
        kinds = ["node", "way", "relation"]
        groups.append(b"".join(field(4, field(1, i) + tags(t) + field(8, packed(s.at(m[2]) for m in ms)) + field(9, delta([m[1] for m in ms])) + field(10, packed(kinds.index(m[0]) for m in ms))) for i, ms, t in relations))
    own = b"".join(field(2, g) for g in groups)
    return field(1, b"".join(field(1, x) for x in s)) + own + field(17, grain) + field(19, base[0]) + field(20, base[1])


def blob(kind, raw, pack=True):
    body = field(2, len(raw)) + field(3, zlib.compress(raw)) if pack else field(1, raw)
    head = field(1, kind) + field(3, len(body))
    return len(head).to_bytes(4, "big") + head + body


def town(seed=1):
    """Blocks of every kind of element, with negative ids and places, a string that looks like a header, and blobs that are not packed."""
    r = random.Random(seed)
    nodes = [(i * 7 - 20, r.randrange(-1_800_000_000, 1_800_000_000), r.randrange(-900_000_000, 900_000_000), {"name": f"é{i}", "highway": "stop"} if i % 3 == 0 else {}) for i in range(900)]
    ways = [(10**12 + i, [r.choice(nodes)[0] for _ in range(r.randint(2, 9))], {"highway": "primary", "n": str(i), "trap": "\n\x07OSMData"}) for i in range(120)]
    relations = [(i, [("way", ways[i][0], "from"), ("node", nodes[i][0], "via"), ("relation", 4, "é")], {"type": "restriction"}) for i in range(20)]
    data = blob(b"OSMHeader", field(4, b"DenseNodes"))
    for i in range(0, 900, 100):
        data += blob(b"OSMData", block(nodes=nodes[i : i + 100]) if i else block(single=nodes[:100]), pack=i % 200 == 0)
    for i in range(0, 120, 30):
        data += blob(b"OSMData", block(ways=ways[i : i + 30], relations=relations if i == 60 else ()), pack=i != 30)
    return data, nodes, ways, relations


def test_varints():
    r = random.Random(2)
    values = [0, 1, 127, 128, (1 << 64) - 1, *(r.getrandbits(r.randint(1, 64)) for _ in range(500))]
    assert pbf.varints(packed(values)).tolist() == values and pbf.varints(b"").tolist() == []
    signed = [0, -1, 1, -(1 << 62), 1 << 62, *(r.randrange(-(1 << 40), 1 << 40) for _ in range(200))]
    assert pbf.zigzag(pbf.varints(packed(map(zig, signed)))).tolist() == signed
    assert pbf.deltas(delta(signed[:1] + signed[5:])).tolist() == signed[:1] + signed[5:]


@pytest.mark.parametrize("split", [1 << 26, 5000, 333])
def test_files_are_read_back_in_any_splits(spark, tmp_path, split):
    data, nodes, ways, relations = town()
    (tmp_path / "a.osm.pbf").write_bytes(data)
    n, w, x = pbf.tables(spark, str(tmp_path / "a.osm.pbf"), split)
    assert n.rdd.getNumPartitions() == -(-len(data) // split)
    got = {r["id"]: (r["lon"], r["lat"], r["tags"]) for r in n.collect()}
    assert got.keys() == {i for i, *_ in nodes} and n.count() == len(nodes)
    for i, lon, lat, tags in nodes:
        assert np.allclose(got[i][:2], (lon * 1e-7, lat * 1e-7), atol=1e-12) and got[i][2] == tags
    assert sorted((r["id"], r["nodes"], r["tags"]) for r in w.collect()) == ways
    assert sorted((r["id"], [tuple(m) for m in r["members"]], r["tags"]) for r in x.collect()) == relations


def test_grain_and_offsets(spark, tmp_path):
    (tmp_path / "b.pbf").write_bytes(blob(b"OSMHeader", b"") + blob(b"OSMData", block(nodes=[(1, -5, 7, {})], grain=1000, base=(2_000_000_000, -3_000_000_000))))
    (tmp_path / "c.pbf").write_bytes(blob(b"OSMHeader", b""))
    r = pbf.tables(spark, f"file://{tmp_path}")[0].collect()
    assert len(r) == 1 and abs(r[0]["lat"] - (2.0 + 7e-6)) < 1e-12 and abs(r[0]["lon"] - (-3.0 - 5e-6)) < 1e-12


def test_what_is_no_pbf(spark, tmp_path):
    (tmp_path / "d.pbf").write_bytes(b"something else entirely")
    with pytest.raises(Exception, match="no blob header at byte 0"):
        pbf.tables(spark, str(tmp_path / "d.pbf"))[0].count()
    body = field(2, 3) + field(4, b"lzma")
    head = field(1, b"OSMData") + field(3, len(body))
    (tmp_path / "e.pbf").write_bytes(len(head).to_bytes(4, "big") + head + body)
    with pytest.raises(Exception, match="not read here"):
        pbf.tables(spark, str(tmp_path / "e.pbf"))[0].count()
    with pytest.raises(Exception, match="no PBF file"):
        pbf.tables(spark, str(tmp_path / "nothing"))[0].count()


def test_a_file_becomes_a_clean_network(spark, tmp_path):
    """A square of streets, one of them one-way, a path that no car may take and a stray pair."""
    at = [(i, 10_000 * (i % 3), 10_000 * (i // 3), {"highway": "traffic_signals"} if i == 4 else {}) for i in range(9)] + [(20, 9_000_000, 0, {}), (21, 9_001_000, 0, {})]
    ways = [(1, [0, 1, 2, 5, 8, 7, 6, 3, 0], {"highway": "residential"}), (2, [1, 4, 7], {"highway": "primary", "oneway": "yes"}), (3, [3, 4, 5], {"highway": "secondary", "maxspeed": "30"}), (4, [20, 21], {"highway": "primary"})]
    (tmp_path / "f.pbf").write_bytes(blob(b"OSMHeader", b"") + blob(b"OSMData", block(nodes=at, ways=ways)))
    nodes, ways_, _ = pbf.tables(spark, str(tmp_path / "f.pbf"))
    assert osm.directed_edges(nodes, ways_, osm.class_table(spark)).count() == 2 * 8 + 2 + 2 * 2 + 2
    n, e, report = osm.from_pbf(spark, str(tmp_path / "f.pbf"))
    pairs = {(a["old_id"], b["old_id"]) for a in n.collect() for b in n.collect() for r in e.collect() if (r["from_node"], r["to_node"]) == (a["node_id"], b["node_id"])}
    assert report.first()["components"] == 2 and n.where("intersection_type = 3").count() == 1
    assert (1, 4) in pairs and (4, 1) not in pairs and (3, 4) in pairs and (4, 3) in pairs and not any(20 in p for p in pairs)
