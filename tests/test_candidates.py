"""Readings of a payload from shared tails equal those that are decoded one by one."""

import random

from paperloom.sources import records


def one_by_one(data):
    for encoding, stride in (("utf-16le", 2), ("utf-8", 1), ("cp949", 1)):
        for at in range(0, min(len(data), 32), stride):
            if len(data) - at >= 2:
                yield encoding, at, data[at:].decode(encoding, errors="ignore")


def payloads():
    rng = random.Random(7)
    words = ["가나다 라마", "Report 2024", "한글 문서입니다.", "é", "漢字", "\U0001f600", "\n", " ", "　", "\x00\x05", "끝"]
    for n in (0, 1, 2, 3, 31, 32, 33, 34, 35, 36, 40, 63, 64, 90):
        for _ in range(12):
            yield rng.randbytes(n)
            yield bytes(rng.choice(b"\x00\x41\xd8\xdc\xe0\xf0\x80\xbf\xb0\xa1\xff\xc8") for _ in range(n))
        said = "".join(rng.choice(words) for _ in range(n))
        for encoding in ("utf-16le", "utf-8", "cp949"):
            yield rng.randbytes(rng.randrange(8)) + said.encode(encoding, "ignore") + rng.randbytes(rng.randrange(4))


def test_readings_equal_single_decodings():
    for data in payloads():
        assert records.shared_decodings(data) == list(one_by_one(data)), data


def test_few_readings_are_decoded_whole():
    class Counted(bytes):
        """Bytes that remember how many of them were cut out to be decoded."""

        cut = 0

        def __getitem__(self, key):
            part = bytes.__getitem__(self, key)
            Counted.cut += len(part) if isinstance(part, bytes) else 0
            return part

    for encoding in ("utf-16le", "utf-8", "cp949"):
        data = ("한글 문서입니다. " * 500).encode(encoding)
        Counted.cut = 0
        assert len(records.shared_decodings(Counted(data))) == 80
        assert Counted.cut < 9 * len(data)  # eighty times as much one by one


def test_null_and_short_payloads(spark):
    df = spark.createDataFrame([(0, None), (1, b""), (2, b"a"), (3, b"ab")], "k int, payload binary")
    assert [len(r.d) for r in df.orderBy("k").select(records.decodings("payload").alias("d")).collect()] == [0, 0, 0, 3]
