"""DataFrames of readers are cut by what is in them."""

from paperloom.sources import batches


def test_long_texts_cut_a_frame_wherever_they_stand():
    rows = [[n, {"runs": [{"text": "x" * (batches.BYTES // 4)}]}, "y" * (batches.BYTES // 4)] for n in range(7)]
    frames = list(batches.batched(iter(rows), ["n", "block", "text"]))
    assert [len(f) for f in frames] == [2, 2, 2, 1]
    assert [n for f in frames for n in f.n] == list(range(7))
