"""Fill-in-the-middle against plain string slices; frames against the texts they hold."""

import hashlib

import pytest
from pyspark.sql import functions as F
from tessera.llm import frames, middle


def plain(doc_id, text):
    t = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(t)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:low], t[low:high], t[high:]
    if h4 % 100 < 20:
        return n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def check(df, **size):
    moved = middle.fill_in_middle(frames.framed(df, **size))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.text) for r in frames.unframed(moved).collect()), key=repr)
    assert got == sorted(((d, *plain(d, t)) for d, t in rows), key=repr)
    hashes = sorted(((r.doc_id, r.output_sha256, r.restored_sha256) for r in middle.digests(moved).collect()), key=repr)
    assert hashes == sorted(((d, sha(plain(d, t)[4]), sha(t or "")) for d, t in rows), key=repr)
    return {r[2] for r in got}


def test_documents(documents):
    assert check(documents) == {"plain", "psm", "spm"}


@pytest.mark.parametrize("size", [1, 7, 65_536])
def test_odd_rows_in_frames_of_any_size(odd, none, size):
    short = odd.where("text is null or length(text) < 6000")
    check(short, frame_bytes=size)
    check(none, frame_bytes=size)


def test_long_texts_of_many_frames(odd):
    long = odd.where("length(text) > 6000")
    assert frames.framed(long).select(F.max(F.size("frames"))).first()[0] > 3
    check(long)


def test_marks_in_texts_and_across_frames(spark):
    texts = ["a<P>b", "<S>", "x" * 20 + "<M>", "<", "<P", "P>", "<<S", "é<M" * 9, "<P><S><M>", "S>M>", "𝒳<S𝒳" * 5]
    df = spark.createDataFrame([(i, t) for i in range(40) for t in texts], "doc_id long, text string")
    check(df, frame_bytes=2)


def test_only_cut_frames_are_packed_anew():
    codec = frames.Codec()
    data = ("pé𝒳" * 3000).encode()
    ends, packed = codec.split(data, 1000)
    assert ends[-1] == len(data.decode()) and b"".join(codec.stream(packed)) == data
    _, out = middle.rearranged(codec, ends, packed, "psm", 1234, 5678)
    assert len(set(packed) - set(out)) <= 2
    assert b"".join(middle.restored(codec, out, "psm")) == data
    assert frames.units(b"".join(codec.span(packed, 0, 5000))) <= 5000


def test_store_is_a_table(odd, tmp_path):
    path = str(tmp_path / "frames")
    frames.framed(odd).write.parquet(path)
    again = odd.sparkSession.read.parquet(path)
    got = sorted(((r.doc_id, r.text) for r in frames.unframed(again).select("doc_id", "text").collect()), key=repr)
    assert got == sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=repr)
