"""Binary logs, written here event by event: every type, both images, key moves, rotation, resumption, and what is refused."""

import json
import struct
import zlib
from datetime import datetime, timezone
from decimal import Decimal

import pytest

from ferryline.sources import binlog as B
from ferryline.sources.trail import Trail
from ferryline.streaming import capture as C


def packed(n):
    return bytes([n]) if n < 251 else b"\xfc" + struct.pack("<H", n)


class Log:
    """A file being written: events with their headers and checksums."""

    def __init__(self):
        self.data, self.tables = bytearray(B.MAGIC), {}
        self.event(B.FORMAT, struct.pack("<H50sIB", 4, b"8.4.0", 0, 19) + bytes(40) + b"\1")

    def event(self, kind, body):
        size = 19 + len(body) + 4
        head = B._HEAD.pack(1, kind, 1, size, len(self.data) + size, 0)
        self.data += head + body + struct.pack("<I", zlib.crc32(head + body))
        return len(self.data)

    def table(self, number, name, columns, names=True):
        """columns: (name, type, metadata bytes, unsigned, collation)."""
        types = bytes(c[1] for c in columns)
        meta = b"".join(c[2] for c in columns)
        more = b""
        numeric = [c for c in columns if c[1] in (1, 2, 3, 4, 5, 8, 9, 13, 246)]
        signs = bytearray((len(numeric) + 7) // 8)
        for i, c in enumerate(numeric):
            signs[i // 8] |= c[3] << (7 - i % 8)
        more += bytes([B.SIGNEDNESS]) + packed(len(signs)) + signs
        text = b"".join(packed(c[4]) for c in columns if c[1] in (15, 252, 254))
        more += bytes([B.COLUMN_CHARSET]) + packed(len(text)) + text
        if names:
            own = b"".join(packed(len(c[0])) + c[0].encode() for c in columns)
            more += bytes([B.COLUMN_NAME]) + packed(len(own)) + own
        more += bytes([B.SIMPLE_PRIMARY_KEY, 1, 0])
        body = number.to_bytes(6, "little") + bytes(2) + b"\2db\0" + packed(len(name)) + name.encode() + b"\0" + packed(len(types)) + types + packed(len(meta)) + meta + bytes((len(types) + 7) // 8) + more
        self.event(B.TABLE_MAP, body)
        self.tables[number] = len(types)

    def rows(self, kind, number, *images, present=None):
        """images: lists of encoded values, None for null; an update has them in pairs."""
        n = self.tables[number]
        full = ((1 << n) - 1 if present is None else present).to_bytes((n + 7) // 8, "little")
        body = number.to_bytes(6, "little") + bytes(2) + struct.pack("<H", 2) + packed(n) + full * (1 + (kind == B.UPDATE))
        for image in images:
            nulls = sum((v is None) << i for i, v in enumerate(image)).to_bytes((n + 7) // 8, "little")
            body += nulls + b"".join(v for v in image if v is not None)
        return self.event(kind, body)

    def commit(self, xid):
        return self.event(B.XID, struct.pack("<Q", xid))

    def save(self, folder, number):
        (folder / f"mysql-bin.{number:06d}").write_bytes(self.data)


INT, TXT = ("id", B.LONG, b"", 0, 0), ("v", B.VARCHAR, struct.pack("<H", 400), 0, 255)
i4 = lambda n: struct.pack("<i", n)
vc = lambda s: struct.pack("<H", len(s.encode())) + s.encode()


def load(spark, path, **options):
    spark.dataSource.register(B.BinlogSource)
    out = spark.read.format("ferryline_binlog").option("path", str(path))
    for k, v in options.items():
        out = out.option(k, v)
    return out.load().orderBy("ord").collect()


def dec(text, precision, scale):
    """A packed decimal, after the format's description."""
    sizes = (0, 1, 1, 2, 2, 3, 3, 4, 4, 4)
    before, _, after = text.lstrip("-").partition(".")
    before, after = before.zfill(precision - scale), after.ljust(scale, "0")
    lead = len(before) % 9
    groups = [before[:lead]] * bool(lead) + [before[k : k + 9] for k in range(lead, len(before), 9)] + [after[k : k + 9] for k in range(0, len(after), 9)]
    out = bytearray(b"".join(int(g).to_bytes(sizes[len(g)], "big") for g in groups))
    if text.startswith("-"):
        out = bytearray(c ^ 0xFF for c in out)
    out[0] ^= 0x80
    return bytes(out)


def test_values_of_every_type(spark, tmp_path):
    day = ((2024 * 13 + 2) << 5 | 29) << 17 | (23 << 12 | 59 << 6 | 58)
    values = [
        ("id", B.LONG, b"", 0, 0, i4(-7), "-7"), ("u", B.LONGLONG, b"", 1, 0, struct.pack("<Q", 2**64 - 1), str(2**64 - 1)), ("t", B.TINY, b"", 0, 0, b"\xff", "-1"), ("s", B.SHORT, b"", 1, 0, b"\xff\xff", "65535"),
        ("m", B.INT24, b"", 0, 0, b"\xfe\xff\xff", "-2"), ("f", B.FLOAT, b"\4", 0, 0, struct.pack("<f", 1.5), "1.5"), ("d", B.DOUBLE, b"\x08", 0, 0, struct.pack("<d", 0.1), "0.1"), ("y", B.YEAR, b"", 0, 0, bytes([124]), "2024"),
        ("n1", B.NEWDECIMAL, b"\x14\x04", 0, 0, dec("-1234567890.1230", 20, 4), "-1234567890.1230"), ("n2", B.NEWDECIMAL, b"\x0a\x02", 0, 0, dec("0.05", 10, 2), "0.05"), ("n3", B.NEWDECIMAL, b"\x05\x05", 0, 0, dec("-.12345", 5, 5), "-0.12345"), ("n4", B.NEWDECIMAL, b"\x12\x00", 0, 0, dec("999999999999999999", 18, 0), "999999999999999999"),
        ("c", B.STRING, bytes([254, 40]), 0, 255, b"\5h\xc3\xa9y!", "héy!"), ("w", B.STRING, bytes([254 ^ 0x30, 0]), 0, 255, struct.pack("<H", 2) + b"ab", "ab"), ("b", B.BLOB, b"\2", 0, B.BINARY, struct.pack("<H", 3) + b"\0\1\xff", "AAH/"), ("x", B.BLOB, b"\2", 0, 255, struct.pack("<H", 2) + "ß".encode(), "ß"),
        ("dt", B.DATETIME2, b"\3", 0, 0, ((1 << 39) + day).to_bytes(5, "big") + (1230).to_bytes(2, "big"), "2024-02-29 23:59:58.123"), ("ts", B.TIMESTAMP2, b"\0", 0, 0, struct.pack(">I", int(datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc).timestamp())), "2024-05-06 07:08:09"), ("da", B.DATE, b"", 0, 0, (2024 << 9 | 2 << 5 | 29).to_bytes(3, "little"), "2024-02-29"),
        ("ti", B.TIME2, b"\0", 0, 0, ((1 << 23) + (838 << 12 | 59 << 6 | 58)).to_bytes(3, "big"), "838:59:58"), ("tn", B.TIME2, b"\0", 0, 0, ((1 << 23) - (1 << 12 | 2 << 6 | 3)).to_bytes(3, "big"), "-01:02:03"), ("bt", B.BIT, bytes([2, 1]), 0, 0, b"\2\1", "513"), ("nu", B.VARCHAR, struct.pack("<H", 9), 0, 255, None, None),
    ]
    log = Log()
    log.table(1, "t", [v[:5] for v in values])
    log.rows(B.WRITE, 1, [v[5] for v in values])
    log.commit(9)
    log.save(tmp_path, 1)
    (r,) = load(spark, tmp_path)
    assert r["after"] == {v[0]: v[6] for v in values} and r["key"] == {"id": "-7"} and (r["op"], r["txn_id"], r["txn_end"]) == ("I", 9, True)


def two_files(folder):
    """A transaction of two events, one of three rows; an update of both kinds; a rotation; a delete."""
    one = Log()
    one.table(1, "t", [INT, TXT])
    one.rows(B.WRITE, 1, [i4(1), vc("a")], [i4(2), vc("b")], [i4(3), None])
    one.rows(B.UPDATE, 1, [i4(1), vc("a")], [i4(1), vc("A")], [i4(2), vc("b")], [i4(20), vc("b")])
    one.commit(100)
    one.event(4, struct.pack("<Q", 4) + b"mysql-bin.000002")
    one.save(folder, 1)
    two = Log()
    two.table(7, "other", [INT, TXT])
    two.rows(B.WRITE, 7, [i4(5), vc("z")])
    two.table(8, "t", [INT, TXT])
    two.rows(B.DELETE, 8, [i4(3), None])
    two.commit(101)
    return two


def seen(rows):
    return [(r["op"], r["table_name"] if "table_name" in r else r["table"], r["key"]["id"], (r["before_key"] or {}).get("id"), r["txn_id"], bool(r["txn_end"])) for r in rows]


ALL = [("I", "t", "1", None, 100, False), ("I", "t", "2", None, 100, False), ("I", "t", "3", None, 100, False), ("U", "t", "1", None, 100, False), ("U", "t", "20", "2", 100, True), ("I", "other", "5", None, 101, False), ("D", "t", "3", None, 101, True)]


def test_rows_keys_and_transactions(spark, tmp_path):
    two_files(tmp_path).save(tmp_path, 2)
    got = load(spark, tmp_path)
    assert seen(got) == ALL and [r["seq"] for r in got] == [0, 1, 2, 0, 1, 0, 0]
    assert got[3]["after"] == {"id": "1", "v": "A"} and got[6]["after"] == {} and [r["base"] for r in got] == sorted(r["base"] for r in got)
    at = got[2]["base"]
    assert at == got[0]["base"] < got[3]["base"] and int(got[5]["base"]) >> 48 == 2
    assert seen(load(spark, tmp_path, file=1, position=int(at) & (1 << 48) - 1)) == ALL[3:] and seen(load(spark, tmp_path, file=2)) == ALL[5:]
    assert seen(load(spark, tmp_path, keys=json.dumps({"t": ["id"]}))) == [x for x in ALL if x[1] == "t"]


def test_capture_goes_on_where_the_trail_ends(spark, tmp_path):
    logs, trail = tmp_path / "logs", Trail(spark, str(tmp_path / "trail"))
    logs.mkdir()
    two = two_files(logs)
    (logs / "identity.json").write_text(json.dumps({"system": "uuid-1", "timeline": 1}))
    keys = {"t": ["id"], "other": ["id"]}
    assert C.capture_binlog(spark, str(logs), trail, keys) == "uuid-1:1" and seen(trail.read().orderBy("seq").collect()) == ALL[:5]
    half = len(two.data)
    two.table(8, "t", [INT, TXT])
    two.rows(B.WRITE, 8, [i4(9), vc("x")])
    two.save(logs, 2)  # its last transaction has not ended
    C.capture_binlog(spark, str(logs), trail, keys, "uuid-1:1")
    assert seen(trail.read().orderBy("seq").collect()) == ALL and half < len(two.data)
    two.commit(102)
    (logs / "mysql-bin.000002").write_bytes(two.data + b"\1\2\3")  # an event that is being written
    for _ in range(2):
        C.capture_binlog(spark, str(logs), trail, keys, "uuid-1:1")
    assert seen(trail.read().orderBy("seq").collect()) == [*ALL, ("I", "t", "9", None, 102, True)]
    part = Trail(spark, str(tmp_path / "part"))
    part.append_frame(trail.read(0, 2).withColumnRenamed("seq", "ord"), "ord")  # a crash inside an event of three rows
    C.capture_binlog(spark, str(logs), part, keys)
    assert seen(part.read().orderBy("seq").collect()) == seen(trail.read().orderBy("seq").collect())
    with pytest.raises(C.AnotherServer):
        C.capture_binlog(spark, str(logs), trail, keys, "uuid-2:1")
    (logs / "mysql-bin.000002").unlink()
    with pytest.raises(ValueError, match="reset"):
        C.capture_binlog(spark, str(logs), trail, keys)


@pytest.mark.parametrize("why, build", [
    ("binlog_row_metadata", lambda x: (x.table(1, "t", [INT, TXT], names=False), x.rows(B.WRITE, 1, [i4(1), vc("a")]))),
    ("binlog_row_image", lambda x: (x.table(1, "t", [INT, TXT]), x.rows(B.WRITE, 1, [i4(1)], present=1))),
    ("not read", lambda x: (x.table(1, "t", [INT, ("e", B.STRING, bytes([247, 1]), 0, 0)]), x.rows(B.WRITE, 1, [i4(1), b"\1"]))),
])
def test_what_would_be_a_guess_is_refused(spark, tmp_path, why, build):
    log = Log()
    build(log)
    log.commit(1)
    log.save(tmp_path, 1)
    with pytest.raises(Exception, match=why):
        load(spark, tmp_path, keys=json.dumps({"t": ["id"]}))


def test_damage_is_told(spark, tmp_path):
    log = two_files(tmp_path)
    log.data[-30] ^= 1
    log.save(tmp_path, 2)
    with pytest.raises(Exception, match="checksum"):
        load(spark, tmp_path)
    (tmp_path / "mysql-bin.000002").write_bytes(b"nothing")
    with pytest.raises(Exception, match="not a binary log"):
        load(spark, tmp_path)
    (tmp_path / "old-bin.000001").write_bytes(b"")
    with pytest.raises(B.UnreadableLog, match="one number"):
        B.LogFiles(str(tmp_path)).listed()
    assert Decimal(dec_back("-12.5")) == Decimal("-12.5")


def dec_back(text):
    return B._decimal(B.Bytes(dec(text, 10, 2)), 10, 2)
