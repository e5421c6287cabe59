import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lodeweave.llm import categories as C
from lodeweave.llm import confusables as X
from lodeweave.llm import packing as K
from lodeweave.llm import personal as P
from lodeweave.llm import tokenize as T

FORMS = {
    "Ðèn trần nổі LΕD 18wаtt": "Đèn trần nổi LED 18watt", "Đｅ̀ｎ　ＬＥＤ": "Đèn LED", " a  b​ ": "a b", "12m² Ø230 – »": "12m² Ø230 – »",
    "Dèn­": "Dèn", "​": "", "": "", "Ɖèn": "Đèn", "a\tb\r\nc": "a b c", "⚡Sale⚡": "⚡Sale⚡", "（x）": "（x）",
}


def test_plain():
    for text, want in FORMS.items():
        assert X.plain(text) == want
        assert X.plain(want) == want
    assert X.skeleton("LΕD") == X.skeleton("LED") != X.skeleton("LeD")


def test_public_table():
    for text in ("𝐋𝐄𝐃", "ⅬED", "LΕD", "ＬＥＤ", "ᏞED", "LꓰD"):
        assert X.skeleton(text) == X.skeleton("LED"), text
    for text, want in {"𝐋𝐄𝐃": "LED", "ⅬED": "LED", "αnh": "anh", "ℓed": "led", "ɴhà": "nhà", "Ꮮed": "Led", "αβγ": "αβγ", "12m² Ø5 º ª ¼ Ⅳ": "12m² Ø5 º ª ¼ Ⅳ", "5 µm": "5 µm", "𝟓0W": "50W", "дом": X.plain("дом"), "עברית": "עברית", "٥": "٥"}.items():
        assert X.plain(text) == want and X.plain(want) == want, text
    assert X.skeleton("modern") == X.skeleton("rnodern") and X.skeleton("Ⅳ") == X.skeleton("lV") and len(X.PUBLIC) > 6000
    with pytest.raises(FileNotFoundError):
        X.public_table("/nowhere.jar")


def test_inconsistent_against_brute_force(spark):
    rng = random.Random(3)
    letters = "aáẩđD Ee  ​ᴀоΟ²Ø–　ｗ́"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 9))) for _ in range(400)] + [*FORMS, "x " * 60_000]
    rows = [(i, t, rng.choice([None, t])) for i, t in enumerate(texts)] + [(-1, None, None), (0, texts[0], None)]
    df = spark.createDataFrame(rows, "id long, name string, plain_text string")
    got = sorted((r.id, r.field, r.plain_text) for r in X.inconsistent(df, "id", ["name", "plain_text"]).collect())
    want = sorted((i, f, X.plain(t)) for i, *ts in rows for f, t in zip(("name", "plain_text"), ts) if t is not None and X.plain(t) != t)
    assert got == want
    assert X.inconsistent(df.limit(0), "id", ["name"]).count() == 0
    groups = {r.skeleton: (r.forms, r.n_rows) for r in X.lookalike_groups(spark.createDataFrame([("LED",), ("LΕD",), ("LED",), (None,), ("B",)], "name string"), ["name"]).collect()}
    assert groups == {"LED": (2, 3), "B": (1, 1)}


REFERENCE = [(1, 101, "Đèn LED chiếu sáng trong nhà"), (1, 105, "Chiếu sáng công nghiệp"), (1, 107, "Linh kiện và phụ kiện đèn"), (1, 103, "Đèn năng lượng mặt trời"), (2, 209, "Đèn cột sân vườn"), (2, 203, "Đèn LED panel"), (2, 207, "Đèn pha LED")]
VALUES = {
    1: {"DDenf LED chieeus sangs trong nhaf": 101, "den-led-chieu-sang-trong-nha": 101, "Đ. LED CS trong nhà": 101, "nhà Đèn LED chiếu sáng trong": 101, "Đèn LED chiếu sáng trng nhà giá rẻ": 101, "Chiếu sáng CN": 105,
        "Linh kiện &amp; phụ kiện đèn": 107, "Đèn NLMT": 103, "» Đèn LED chiếu sáng trong nhà (12)": 101, "Máy lọc nước": 0, "???": 0, "": 0, "Ðèn​ năng lượng mặt trờі": 103, "Đèn LED panel": 0, "x" * 50_000: 0},
    2: {"Đ. cột s/vườn": 209, "Đèn LED apnel - Denvuon": 203, "Đèn pha EkD": 207, "Đèn pin đội đầu": 0},
}


def test_categories(spark):
    reference = spark.createDataFrame(REFERENCE, "level int, category_id long, name string")
    cases = [(level, v, e) for level, vs in VALUES.items() for v, e in vs.items()]
    rows = [(i, v if level == 1 else None, v if level == 2 else None, "x") for i, (level, v, _) in enumerate(cases)]
    rows += [(900, "Chiếu sáng công nghiệp", None, "x"), (901, None, None, "x"), (902, "Chiếu sáng CN", None, "x"), (902, "Chiếu sáng CN", None, "x")]
    df = spark.createDataFrame(rows, "id long, category_1 string, category_2 string, category_id string")
    got = [tuple(r) for r in C.map_categories(df, reference, fields=["category_1", "category_2"]).collect()]
    assert sorted(got) == sorted([(i, level, e) for i, (level, _, e) in enumerate(cases)] + [(902, 1, 105)] * 2)
    assert C.map_categories(df.limit(0), reference, fields=["category_1"]).count() == 0


def test_symmetric_delete_finds_all_within_distance():
    rng = random.Random(8)
    names = ["".join(rng.choice("bcgh") for _ in range(rng.randint(8, 11))) for _ in range(40)]
    d = C.Dictionary([(i + 1, n, 0) for i, n in enumerate(names)])
    for _ in range(200):
        w = list(rng.choice(names))
        for _ in range(2):
            w[rng.randrange(len(w))] = rng.choice("bcgh")
        word = "".join(w)
        near = {i + 1 for i, n in enumerate(names) if C.weighted_distance(word, n, 2) <= 2}
        assert (d.find(word) in near) if near else True


def edited(rng, word):
    """The word after one insertion, deletion, substitution or transposition."""
    w, k = list(word), rng.randrange(4)
    i = rng.randrange(len(w) + (k == 0) - (k == 3))
    if k == 0:
        w.insert(i, rng.choice("abcxyz"))
    elif k == 1:
        del w[i]
    elif k == 2:
        w[i] = rng.choice("abcxyz")
    else:
        w[i], w[i + 1] = w[i + 1], w[i]
    return "".join(w)


def test_weighted_distance_is_at_most_the_edits():
    rng = random.Random(1)
    for _ in range(2000):
        word = "".join(rng.choice("abcxyz") for _ in range(rng.randint(5, 9)))
        once = edited(rng, word)
        twice = edited(rng, once)
        assert C.weighted_distance(word, once, 9) <= 1 and C.weighted_distance(word, twice, 9) <= 2 and C.weighted_distance(twice, word, 2) <= 2
    assert C.weighted_distance("khan", "akn", 2) == 2 and C.weighted_distance("abc", "abc", 0) == 0 and C.weighted_distance("abc", "xyz", 1) > 1
    assert 0.7 <= C.weighted_distance("chanh", "chann", 9) <= 0.8 and C.weighted_distance("led", "leed", 9) == 0.7


def test_all_names_within_two_edits_are_found():
    rng = random.Random(8)
    names = ["".join(rng.choice("bcghkmp") for _ in range(rng.randint(8, 12))) for _ in range(60)]
    d = C.Dictionary([(i + 1, n, 0) for i, n in enumerate(names)])
    for _ in range(300):
        word = edited(rng, edited(rng, rng.choice(names)).replace("x", "b").replace("y", "c").replace("z", "g").replace("a", "k"))
        near = {i + 1: C.weighted_distance(word, n, 2) for i, n in enumerate(names)}
        best = min(near.values())
        if best <= 2 and "a" not in word:
            assert near[d.find(word)] <= 2, word


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.vocabulary_path())


def test_encoder_against_public_library(encoder):
    tiktoken = pytest.importorskip("tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice("abAB 019.,;\n\t\r'sđếư💡👨‍🔧́=<|>") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts += ["<|endoftext|>", "a" * 30_000, "ab" * 20_000, "=" * 9_999, " " * 5_000 + "x", "it's  we'll\n\n", " ", "日本語テキスト"]
    for t in texts:
        assert encoder.encode(t) == theirs.encode_ordinary(t), t[:60]
        assert encoder.decode(encoder.encode(t)).decode() == t
    assert encoder.encode(None) == encoder.encode("") == []


def test_encoder_is_linear_on_long_pretokens(encoder):
    assert b"".join(encoder.bytes_of[i] for i in encoder.merge(b"xyz0/+" * 50_000)) == b"xyz0/+" * 50_000


def test_encode_column(spark, encoder):
    rows = [(1, "Đèn LED", "x"), (2, None, "x"), (3, "", "x"), (1, "Đèn LED", "x"), (None, "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids)) for r in T.encode_column(df).collect()), key=str)
    assert got == sorted([(i, encoder.encode(t)) for i, t, _ in rows], key=str)
    assert T.encode_column(df.limit(0)).count() == 0


def packed(spark, sizes, capacity, parts, **bounds):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, size int").repartition(parts)
    return K.pack(df, id="id", column="size", capacity=capacity, size_of=lambda: lambda s: [int(x or 0) for x in s], **bounds)


@pytest.mark.parametrize("seed,parts,run,bins", [(1, 1, 100_000, 20_000), (2, 9, 50, 20_000), (3, 20, 50, 20_000), (4, 20, 10, 7)])
def test_packing(spark, seed, parts, run, bins):
    """The bounds are arguments and so take effect on the workers; beyond them no bin is left out."""
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 7, 33, 50, 64, 99, 100, 101, 250, 300]) for _ in range(400)]
    rows = packed(spark, sizes, 100, parts, run_items=run, bins_per_task=bins).collect()
    of: dict = {}
    for r in rows:
        of.setdefault(r.id, []).append((r.piece, r.tokens))
    assert {i: sorted(v) for i, v in of.items()} == {i: list(enumerate(K.pieces(s, 100))) for i, s in enumerate(sizes)}
    fill: dict = {}
    for r in rows:
        assert (r.container is None) == (r.tokens == 0)
        if r.tokens:
            fill[r.container] = fill.get(r.container, 0) + r.tokens
    assert max(fill.values()) <= 100
    print(seed, len(fill), sum(sizes) / 100)
    assert len(fill) <= 1.03 * sum(sizes) / 100 + 3


def test_packing_of_what_does_not_fit_together(spark):
    """Items of more than half a container: rounds end when they save nothing."""
    rows = packed(spark, [51] * 300, 100, 6, run_items=20, bins_per_task=10).collect()
    assert len(rows) == len({r.container for r in rows}) == 300
    assert packed(spark, [], 100, 1).count() == 0
    # More bins than a task takes, of which each needs one of another partition.
    rows = packed(spark, [60] * 200 + [40] * 200, 100, 8, run_items=20, bins_per_task=40).collect()
    assert len(rows) == 400 and len({r.container for r in rows}) <= 215


def test_best_fit_against_plain_best_fit():
    rng = random.Random(2)
    for _ in range(50):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(0, 60))]
        rooms: list[int] = []
        for s in sorted(sizes, reverse=True):
            fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
            if fits:
                rooms[min(fits)[1]] -= s
            else:
                rooms.append(40 - s)
        bins = K.best_fit(sizes, 40)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert sorted(40 - sum(sizes[i] for i in b) for b in bins) == sorted(rooms)


def test_abbreviations_late_in_the_alphabet():
    words = [f"t{c}n" for c in "abcdefghiklm"]
    d = C.Dictionary([(i, f"đèn {w}", 1) for i, w in enumerate(words)] + [(50, "đèn txx viền", 1), (60, " ".join(f"{c}zz" for c in "abcdefgh"), 1), (61, " ".join(f"{c}yy" for c in "abcdefgh"), 1)])
    assert d.find("đèn t. viền") == 50 and d.find("a. b. c. d. e. f. g. hzz") == 60


PERSONAL = [
    ("Chị Trần Uyên Thoại (+84 309 772 671) báo đèn hỏng", {("name", "Trần Uyên Thoại"), ("phone", "+84 309 772 671")}),
    ("Từ: trịnh diệu xuyến <msenh [a còng] post chấm hopthu chấm example> .", {("name", "trịnh diệu xuyến"), ("email", "msenh [a còng] post chấm hopthu chấm example")}),
    ("Giao đến số nhà 40, hẻm 68/6 Đồng Xanh, phường Đông Gốm, TP Hải Vân Đông nhé shop", {("address", "số nhà 40, hẻm 68/6 Đồng Xanh, phường Đông Gốm, TP Hải Vân Đông")}),
    ("Our installer Nelda Wrenhollow visited 372 Banyan Court, Ward 8, Minh Loc City on 9/5", {("name", "Nelda Wrenhollow"), ("address", "372 Banyan Court, Ward 8, Minh Loc City")}),
    ("Số CCCD: 097 804 376 764, họ tên Bui Dieu Kha", {("id_number", "097 804 376 764"), ("name", "Bui Dieu Kha")}),
    ("Passport X4062019 was shown by TRẦN YÊN TRÀ", {("id_number", "X4062019"), ("name", "TRẦN YÊN TRÀ")}),
    ("gọi 095769550O hoặc (0202) 6392 292 sau 17h", {("phone", "095769550O"), ("phone", "(0202) 6392 292")}),
    ("Vũ N. Xuyến đánh giá 5 sao", {("name", "Vũ N. Xuyến")}),
    ("Gọi miễn phí 1800 0703, mã SAP 4000064819, mã vạch 8931521088286, số lô 06824920-9, id=00520443", set()),
    ("Theo dõi @TavoluxLight. Listed at 2.903.000 VND on ledgiare.example, tax not included", set()),
    ("Vo den lam tu thuy tinh mo. Công ty TNHH Chiếu Sáng Bình Lộc, Khu Công Nghiệp Tân Sậy", set()),
    ("Nhân viên tư vấn trả lời, lưu ý giữ xa nguồn nhiệt", set()),
]


@pytest.mark.parametrize("text,want", PERSONAL)
def test_personal(text, want):
    assert {(f.kind, f.text) for f in P.find(text)} == want
    odd = unicodedata.normalize("NFD", text).replace(" ", " ")
    found = P.find(odd)
    assert {(f.kind, unicodedata.normalize("NFC", f.text).replace(" ", " ")) for f in found} == want
    assert all(odd[f.start : f.end] == f.text for f in found)


HAMLETS = [
    ("Giao về thôn Đông, xã Tân Lập, huyện Ba Vì nhé", "thôn Đông, xã Tân Lập, huyện Ba Vì"), ("ở thôn 3, xã Tân Lập nhé", "thôn 3, xã Tân Lập"), ("thôn Đông, số 5, xã Tân Lập", "thôn Đông, số 5, xã Tân Lập"),
    ("gửi 12 Hoa " + "Mai " * 15 + "Xanh, phường Ba", "12 Hoa " + "Mai " * 15 + "Xanh, phường Ba"), ("đèn làng nghề, giá 5 đồng, bền", None),
]


@pytest.mark.parametrize("text,want", HAMLETS)
def test_addresses_of_hamlets(text, want):
    assert [f.text for f in P.find(text) if f.kind == "address"] == ([want] if want else [])
    assert want is None or want not in P.surrogate_text(text, P.Surrogates(b"k" * 32))


@pytest.mark.parametrize(
    "text,want",
    [
        ("ông Đậu Văn Bền gọi lại", "Đậu Văn Bền"), ("Người nhận: Kpă Thuyên", "Kpă Thuyên"), ("Contact: Jean-Luc Picard now", "Jean-Luc Picard"), ("Maria da Silva wrote", "Maria da Silva"), ("Mr. Ole Gunnar Sund", "Ole Gunnar Sund"),
        ("Người nhận: Công Ty Chiếu Sáng", None), ("của người mua\n Dòng Bageryx bền", None), ("Contact: Customer Service", None), ("ông Ưu điểm", None),
    ],
)
def test_names_beyond_the_lists(text, want):
    assert [f.text for f in P.find(text) if f.kind == "name"] == ([want] if want else [])


#: Invented names of which no word is in a list.
RARE = ["Đậu Đượng Bền", "Kpă Thuyn", "Y Moan Ênuôl", "Jean-Luc Picard", "Ole Gunnar Sund", "Zsófia Kocsis", "Håkan Ørsted", "Siu Blêk", "Rơ Châm Phiang", "Giàng Sèo Phử"]


def test_recall_beyond_the_lists():
    frames = ["Người nhận: {}, giao giờ hành chính", "Họ và tên: {}", "Khách hỏi, ông {} trả lời", "Contact: {}, tomorrow", "Mr. {} will call", "my name is {}, hello", "Người liên hệ: {} (kho)", "Attn: {}"]
    found = [name in {f.text for f in P.find(frame.format(name))} for name in RARE for frame in frames]
    print(f"recall {sum(found)}/{len(found)}")
    assert sum(found) >= 0.9 * len(found)


def new_names(text, s):
    return [new for _, new, _, _ in P.assigned(text, s)]


def test_surrogates_keep_persons_apart_and_together():
    s = P.Surrogates(b"k" * 32)
    for a, b in (("Trần Thị Nga", "Trần Thị Ngà"), ("Lê Thị Yên", "Lê Thị Yến"), ("Trần Thị Nga", "Trần Thị Ngá"), ("Đậu Văn Bền", "Đậu Văn Bến")):
        x, y = new_names(f"ông {a}; ông {b}", s)
        assert x != y and P.fold(a) not in P.fold(x)
    x, y, z = new_names("Anh Nguyễn Văn Thành và chị Nguyễn Văn Thành; NGUYEN VAN THANH", s)
    assert x == y and z == P.fold(x).upper()
    # Without accents it can only be the one it fits; of two it is none in particular.
    assert new_names("ông Đậu Văn Bền, Người nhận: Dau Van Ben", s)[1] == P.fold(new_names("ông Đậu Văn Bền", s)[0]).title()
    a, b, c = new_names("0951 632 845, +84 951 632 845, 0951632846", s)
    assert a.replace(" ", "")[1:] == b.replace(" ", "")[3:] and c != a.replace(" ", "")
    a, b = new_names("x.y@mail.example, x.y [at] mail [dot] example", s)
    assert a.replace("@", " [at] ").replace(".example", " [dot] example") == b and a.endswith(".example") and "mail" not in a
    assert new_names("Maria da Silva wrote", s)[0].split()[1] == "da"


def test_surrogates_are_one_to_one():
    import itertools

    for key in (b"k" * 32, b"q" * 32, b"registered query"):
        s = P.Surrogates(key)
        words = ["".join(w) for n in (1, 2, 3) for w in itertools.product("abđeếdớx", repeat=n)] + ["an" * k for k in range(1, 12)] + ["мир", "мира", "ñandú", "ñandu"]
        assert len({s.syllables(w) for w in words}) == len(words)
        names = [" ".join(w) for w in itertools.product(P.SURNAMES, ("thị", "văn", "đượng"), [*P.FEMALE, *P.MALE, *P.EITHER, "bền", "bến"])]
        assert len({s.name(n) for n in names}) == len(set(names))
        for kind, texts in (("phone", [f"09516{i:05d}" for i in range(4000)]), ("id_number", [f"X{i:07d}" for i in range(4000)]), ("email", [f"{a}{i}@{b}.vn" for a in ("an", "na") for b in ("x", "y") for i in range(500)])):
            new = {s.of(kind, t) for t in texts}
            assert len(new) == len(texts) and all(len(t) == len(n) for t, n in zip(texts, map(lambda t: s.of(kind, t), texts))) or kind == "email"
    with pytest.raises(ValueError):
        P.one_to_one({"a": "b", "c": "b"})


def test_surrogates_over_documents(spark):
    rows = [(i, f"Chị {a} và {b}, 09516328{i:02d}, x{i}@mail.example", "clash") for i, (a, b) in enumerate([("Trần Thị Nga", "Trần Thị Ngà"), ("Lê Thị Yên", "Lê Thị Yến"), ("Trần Thị Ngà", "Tran Thi Nga"), ("Phạm Văn Thành", "Phạm Thị Thanh")])]
    pairs = P.personal_pairs(spark.createDataFrame(rows, "doc_id long, text string, entity string"), "key")
    assert {(r.split, r.merged) for r in P.distinctness(pairs).collect()} == {(0, 0)}
    assert P.personal_pairs(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), "key").count() == 0


def test_surrogates():
    s = P.Surrogates(b"k" * 32)
    text = "Chị Trần Uyên Thoại gọi 0951 632 845; TRAN UYEN THOAI, 0951632845, 0951632846, hộ chiếu Q6337739, cskh.hoai@inbox.test"
    out = P.surrogate_text(text, s)
    assert out == P.surrogate_text(text, s) and out != P.surrogate_text(text, P.Surrogates(b"q" * 32))
    kinds = [(f.kind, re.sub(r"\d", "0", f.text) if f.kind in ("phone", "id_number") else "") for f in P.find(text)]
    assert kinds[1][1] == "0000 000 000" and len(kinds) == 7
    new = out.split("; ")[1].split(", ")
    first = out.split(" gọi ")[0].removeprefix("Chị ")
    assert P.fold(first).upper() == new[0] and new[1] == out.split("; ")[0].split(" gọi ")[1].replace(" ", "") and new[1] != new[2]
    assert re.fullmatch(r"hộ chiếu [A-Z]\d{7}", new[3]) and re.fullmatch(r"[a-z.]+@[a-z.]+", new[4])
    seen = {s.digits(f"{i:04d}", "x") for i in range(10_000)}
    assert len(seen) == 10_000
    assert P.surrogate_text(None, s) is None and P.surrogate_text("", s) == ""


def test_personal_columns(spark):
    rows = [(1, PERSONAL[0][0], "a"), (2, None, "a"), (3, "", "a"), (4, "x " * 100_000 + PERSONAL[0][0], "a"), (5, PERSONAL[0][0] + "\n" + PERSONAL[0][0], "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted(tuple(r) for r in P.find_personal(df, "key").collect())
    assert got == sorted((i, k, v) for i in (1, 4, 5) for k, v in PERSONAL[0][1])
    texts = {r.doc_id: r.text for r in P.replace_personal(df, "key").collect()}
    assert len(texts) == 5 and texts[2] is None and texts[3] == "" and "Thoại" not in texts[1]
    assert P.find_personal(df.limit(0), "key").count() == P.replace_personal(df.limit(0), "key").count() == 0
    assert F is not None


def test_slots_against_all_products():
    import itertools

    rng = random.Random(5)
    for _ in range(300):
        slots = [["".join(rng.choice("abc") for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
        key = "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
        whole = min(C.weighted_distance("".join(p), key, 99) for p in itertools.product(*slots))
        got = C.slots_distance(slots, key, 99)
        # Without letters transposed across slots it can only be more, and at most by what a transposition saves.
        assert whole - 1e-9 <= got and (got <= 2 * whole + 1e-9)
    assert C.slots_distance([["x"] * 50] * 60, "abc", 2) == float("inf") and C.slots_distance([["ab", "trong"], ["", "nha"]], "trongnha", 2) == 0


def test_many_choices_and_a_typing_error():
    """More choices a word, and more readings in all, than were once looked up."""
    words = [f"t{a}{b}n" for a in "abcdefghij" for b in "aeiou"]
    names = [(i + 1, f"đèn {w} {v} xanh trời", 1) for i, (w, v) in enumerate(zip(words, reversed(words)))]
    d = C.Dictionary(names)
    for i in (0, 17, 49):
        typed = names[i][1].split()
        assert d.find(f"đ. t. {typed[2]} xnah t.") == i + 1
    with pytest.raises(ValueError):
        C.Dictionary(names, max_keys=100)


def test_vocabulary_is_a_parameter():
    d = C.Dictionary([(1, "jardin public", 1)], C.Vocabulary({"garden": "jardin"}, ("pas cher",), ("rayon",)))
    assert d.find("Rayon: garden public pas cher") == 1 and d.find("indoor public") == 0
    assert C.Dictionary([], C.Vocabulary()).find("x") == 0
