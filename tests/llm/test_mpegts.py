import hashlib
import random
import zlib

import pytest

from marlstone.llm import mpegts as M


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 162, 163, 170, 176, 8191, 8192, 8193, 100_000])
def test_round_trip(n):
    text = random.Random(n).randbytes(n)
    found = M.demux(M.mux(M.padded(text)))
    stream = found.streams[M.ES_PID]
    assert b"".join(u.data for u in stream.units) == M.padded(text)
    assert found.programs == {M.PROGRAM: M.PMT_PID} and stream.kind == M.PRIVATE
    assert stream.continuity_errors == stream.damaged == found.crc_errors == found.lost_bytes == 0
    assert [u.pts for u in stream.units] == [M.FIRST_PTS + i * M.TICK for i in range(len(stream.units))]
    assert [u.random_access for u in stream.units] == [i % M.GROUP == 0 for i in range(len(stream.units))]


def test_damage_is_seen():
    ts = M.mux(M.padded(bytes(50_000)))
    gone = M.demux(ts[: 188 * 20] + ts[188 * 21 :]).streams[M.ES_PID]
    assert gone.continuity_errors == 1 and gone.damaged == 1
    twice = M.demux(ts[: 188 * 20] + ts[188 * 19 :]).streams[M.ES_PID]
    assert twice.duplicates == 1 and twice.continuity_errors == 0
    shifted = M.demux(b"garbage" + ts[: 188 * 20] + b"zz" + ts[188 * 20 :])
    assert shifted.lost_bytes == 9 and shifted.streams[M.ES_PID].continuity_errors == 0
    assert M.demux(b"").programs == {} and M.demux(b"x" * 1000).streams == {}
    bad = bytearray(ts)
    bad[10] ^= 1
    assert M.demux(bytes(bad)).crc_errors == 1


def test_query_columns(spark, docs_of, odd_texts):
    rows = M.stored(docs_of(odd_texts)).mapInArrow(M._decode, M.FEATURES).collect()
    want = []
    for doc_id, text in odd_texts:
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    assert all(r.media_bytes % 188 == 0 and "continuity_errors=0" in r.feature for r in rows)
    assert len({r.media_sha256 for r in rows}) == len({r.payload_sha256 for r in rows})


def test_empty_table(spark, docs_of):
    assert M.stored(docs_of([])).mapInArrow(M._decode, M.FEATURES).count() == 0
