"""A Level II volume written out by hand, field by field, as the public interface document lays it out; no encoder of the library takes part."""

import bz2

import pytest
from pyspark.sql import functions as F

from galefold.sources import level2

VOLUME_HEADER = "41523256 30303036 2E 303031" + "00004A1C" + "00000000" + "4B414B51"  # AR2V0006. 001, day 18972, 0 ms, KAKQ
VOL = "52 564F4C 002C 01 00 4213EB85 C29A051F 0022 0019" + "00000000" * 5 + "00D4 0000"  # R VOL, 44 bytes, 36.98 north, 77.01 west, 34 m, 25 m, pattern 212
ELV = "52 454C56 000C 0000 00000000"
RAD = "52 524144 0014 01D2 C2A00000 C2A10000 04BA 0000"  # noise -80 and -80.5, Nyquist 12.10 m/s


def moment(name: str, count: str, first: str, spacing: str, word: str, scale: str, offset: str, codes: str) -> str:
    return "44" + name + "00000000" + count + first + spacing + "0000 0000 00" + word + scale + offset + codes


REF = moment("524546", "0006", "084D", "00FA", "08", "40000000", "42840000", "00 01 02 42 86 FF")  # 2125 m, 250 m, (code - 66) / 2
VEL = moment("56454C", "0004", "084D", "00FA", "08", "40000000", "43010000", "81 01 00 91")  # (code - 129) / 2
PHI = moment("504849", "0003", "0000", "00FA", "10", "40359EEC", "40000000", "0000 0003 03FF")  # 16 bits, (code - 2) / 2.838
CFP = moment("434650", "0002", "0000", "00FA", "08", "3F800000", "00000000", "05 06")  # a moment that isn't read


def radial(blocks: list[str], number: str, azimuth: str, elevation: str, ms: str, place: str) -> bytes:
    parts = [bytes.fromhex(b) for b in blocks]
    at, pointers = 72, []
    for p in parts:
        pointers.append(at.to_bytes(4, "big"))
        at += len(p)
    pointers += [bytes(4)] * (10 - len(pointers))
    head = bytes.fromhex("4B414B51" + ms + "4A1C" + place + azimuth + "00 00 0000 01 01" + number + "01" + elevation + "00 00" + f"{len(parts):04X}")
    body = head + b"".join(pointers) + b"".join(parts)
    assert len(head) == 32
    body += bytes(len(body) % 2)
    size = (len(body) + 16) // 2
    return bytes(12) + size.to_bytes(2, "big") + bytes.fromhex("00 1F" + place + "4A1C" + ms + "0001 0001") + body


def other() -> bytes:
    """A status message in a frame of 2,432 bytes."""
    return (bytes(12) + bytes.fromhex("0048 00 02 0007 4A1C 00000000 0001 0001") + b"\x55" * 128).ljust(2432, b"\0")


def volume() -> bytes:
    first = other() + radial([VOL, ELV, RAD, REF, PHI], "01", "41280000", "3F000000", "000003E8", "0001") + radial([VOL, ELV, RAD, REF], "01", "41380000", "3F000000", "000003E9", "0002")
    second = radial([VOL, ELV, RAD, VEL, CFP], "02", "41280000", "3F0CCCCD", "00005208", "0001") + radial([VOL, ELV, RAD, REF, VEL], "03", "43B38000", "3FB33333", "0000EA60", "0001")
    one, two = bz2.compress(first), bz2.compress(second)
    return bytes.fromhex(VOLUME_HEADER) + len(one).to_bytes(4, "big") + one + (-len(two)).to_bytes(4, "big", signed=True) + two


def test_every_field_is_read_where_it_stands(spark, tmp_path):
    (tmp_path / "KAKQ20211211_000000_V06").write_bytes(volume())
    rows = level2.read_volumes(spark, str(tmp_path)).orderBy("block_idx", "seq").collect()
    assert [(r.icao, r.block_idx, r.seq, r.days, r.collect_ms, r.elevation_number, r.azimuth_deg) for r in rows] == [("KAKQ", 0, 0, 18972, 1000, 1, 10.5), ("KAKQ", 0, 1, 18972, 1001, 1, 11.5), ("KAKQ", 1, 0, 18972, 21000, 2, 10.5), ("KAKQ", 1, 1, 18972, 60000, 3, 359.0)]
    assert [round(r.elevation_deg, 5) for r in rows] == [0.5, 0.5, 0.55, 1.4]
    assert {(round(r.nyquist_ms, 4), round(r.lat, 4), round(r.lon, 4), r.vcp) for r in rows} == {(12.1, 36.98, -77.01, 212)}
    moments = [[(m.name, m.gate_count, m.first_gate, m.gate_spacing, m.word_size, round(m.scale, 3), m.offset, list(m.codes)) for m in r.moments] for r in rows]
    ref, vel = ("REF", 6, 2125, 250, 8, 2.0, 66.0, [0, 1, 2, 66, 134, 255]), ("VEL", 4, 2125, 250, 8, 2.0, 129.0, [129, 1, 0, 145])
    assert moments == [[ref, ("PHI", 3, 0, 250, 16, 2.838, 2.0, [0, 3, 1023])], [ref], [vel], [ref, vel]]


def test_gates_and_the_data_source_agree(spark, tmp_path):
    (tmp_path / "KAKQ20211211_000000_V06").write_bytes(volume())
    gates = level2.radial_gates(level2.read_volumes(spark, str(tmp_path)))
    got = sorted((r.elevation_number, r.seq, r.moment, r.gate_idx, r.range_m, round(r.value, 3), r.ray_idx) for r in gates.where("moment <> 'PHI'").collect())
    ref = lambda e, s, ray: [(e, s, "REF", g, 2125.0 + 250 * g, v, ray) for g, v in ((1, -32.5), (2, -32.0), (3, 0.0), (4, 34.0), (5, 94.5))]
    vel = lambda e, s, ray: [(e, s, "VEL", 0, 2125.0, 0.0, ray), (e, s, "VEL", 3, 2875.0, 8.0, ray)]
    codes = {(e, s, m, g) for e, s, m, g, *_ in got}
    want = ref(1, 0, None) + ref(1, 1, None) + vel(2, 0, 0) + ref(3, 1, 0) + vel(3, 1, 0)
    # Code 1 is range folding where a moment has it; the rule is S.valid_code's.
    want = [w for w in want if w[:4] in codes]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) >= 16
    assert sorted(round(r.value, 3) for r in gates.where("moment = 'PHI'").collect())[-1] == pytest.approx((1023 - 2) / 2.8378, abs=0.01)
    spark.dataSource.register(level2.Level2DataSource)
    source = spark.read.format("level2").load(str(tmp_path))
    plain = level2.read_volumes(spark, str(tmp_path))
    key = lambda f: sorted(map(str, f.select("block_idx", "seq", "azimuth_deg", F.to_json("moments")).collect()))
    assert key(source) == key(plain)


def test_damaged_bytes_give_no_rows_and_no_error(spark, tmp_path):
    whole = volume()
    (tmp_path / "cut").write_bytes(whole[: len(whole) - 40])
    (tmp_path / "short").write_bytes(whole[:10])
    (tmp_path / "none").write_bytes(b"")
    (tmp_path / "torn").write_bytes(whole[:60] + b"\xff" * 30 + whole[90:])
    rows = level2.read_volumes(spark, str(tmp_path)).groupBy("volume_id").count().collect()
    assert {r.volume_id: r["count"] for r in rows} == {"cut": 2, "torn": 2}
