import hashlib
import random
import re

from tracelake.llm import fim

PARTS = ["a", "Zb", "é", "😀", " ", "\n", "<", "P", ">", "@", "[", "`", "{", "\0", "ſ"]


def brute(doc_id, text):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, drawn = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", text, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 20:
        return n, "spm", f"<S>{s}<P>{p}<M>{m}", len(p), len(m)
    return n, "psm", f"<P>{p}<S>{s}<M>{m}", len(p), len(m)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_arranging_and_restoring_against_brute_force():
    random.seed(1)
    forms = set()
    for k in range(4_000):
        text = "".join(random.choice([*PARTS, "<M>"] if k % 9 == 0 else PARTS) for _ in range(random.choice([0, 1, 2, 5, 40])))
        done = fim.arrange(k, text.encode())
        want = brute(k, text)
        assert (done.n_units, done.form, done.table.content().decode()) == want[:3]
        assert fim.restored(done.table.content(), done.form).content().decode() == text
        assert done.table.sha256() == sha(want[2])
        forms.add(done.form)
    assert forms == {"plain", "psm", "spm"}


def test_cutting_splits_descriptors_without_touching_text():
    table = fim.PieceTable.of(b"abcdef")
    cut = table.cut(2, 2, 6).cut(1)
    assert [bytes(s) for s in cut.spans()] == [b"a", b"b", b"", b"cdef", b""]
    assert cut.text is table.text and cut.content() == b"abcdef"
    swapped = cut.arranged([3, 0, 1, 2, 4])
    assert swapped.content() == b"cdefab"
    assert swapped.arranged([1, 2, 3, 0, 4]).content() == b"abcdef"


def test_messy_documents(spark, messy):
    rows = fim.fill_in_middle(messy, ["doc_id", "text", "rank"]).collect()
    assert len(rows) == messy.count()
    for r in rows:
        text = r.text or ""
        assert (r.n, r.form, r.output, r.prefix_chars, r.middle_chars) == brute(r.doc_id, text)
        assert r.output_sha256 == sha(r.output) and r.restored_sha256 == sha(text)
        buffers = {"text": text.encode(), "sentinel": fim.SENTINELS}
        assert b"".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces).decode() == r.output
        assert r["rank"] == 9


def test_rates_and_no_documents(spark, messy, empty):
    assert {r.form for r in fim.fill_in_middle(messy, rate=0).collect()} == {"plain"}
    assert {r.form for r in fim.fill_in_middle(messy, rate=100, suffix_first=100).collect()} == {"plain", "spm"}  # plain: without text
    assert fim.fill_in_middle(empty).count() == 0
