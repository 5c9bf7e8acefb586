"""Personal information: items of every kind in four languages, decoys, pseudonyms and edge cases."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from loadweave.llm import personal as P
from loadweave.llm import pseudonyms as S

GIVEN = frozenset(["anna", "ewan", "jürgen", "héloïse", "íñigo"])


def found(text, given=GIVEN):
    return [(k, text[a:b]) for a, b, k in P.find_items(text, given)]


CASES = [
    ("Write to anna.smith+x@sub.mail.example.", [("email", "anna.smith+x@sub.mail.example")]),
    ("mailto:e_w@post.example by default", [("email", "e_w@post.example")]),
    ("ewan (at) mail dot example or x [at] y.test", [("email", "ewan (at) mail dot example"), ("email", "x [at] y.test")]),
    ("a.b at sub (dot) mail (dot) example, thanks", [("email", "a.b at sub (dot) mail (dot) example")]),
    ("Ring 07700 900123 or +44 (0)20 7946 0123 (07700.900.124)", [("phone", "07700 900123"), ("phone", "+44 (0)20 7946 0123"), ("phone", "07700.900.124")]),
    ("(020) 7946 0001; 0044 1632 960001; +447700900001", [("phone", "(020) 7946 0001"), ("phone", "0044 1632 960001"), ("phone", "+447700900001")]),
    ("Tel. (030) 23125001, 030/23125-001, +49 30 23125 001", [("phone", "(030) 23125001"), ("phone", "030/23125-001"), ("phone", "+49 30 23125 001")]),
    ("Tél. : 01.99.00.00.01 ou +33 6 39 98 00 01", [("phone", "01.99.00.00.01"), ("phone", "+33 6 39 98 00 01")]),
    ("Llamar al 555 012 001 o al 555-01-2001", [("phone", "555 012 001"), ("phone", "555-01-2001")]),
    ("NI number qq123456c and AB-12-34-56-C", [("identity", "qq123456c"), ("identity", "AB-12-34-56-C")]),
    ("passport no 512345678 and licence SMITH701015A99AB", [("identity", "512345678"), ("identity", "SMITH701015A99AB")]),
    ("Steuer-ID 12 345 678 901. Personalausweis T22000129.", [("identity", "12 345 678 901"), ("identity", "T22000129")]),
    ("n° de sécurité sociale 1 85 05 78 006 084 36.", [("identity", "1 85 05 78 006 084 36")]),
    ("con DNI núm. 12345678-Z y NIE X1234567L", [("identity", "12345678-Z"), ("identity", "X1234567L")]),
    ("at 32 Foxglove Mews, Quenton BJ10 7ET by mistake", [("address", "32 Foxglove Mews, Quenton BJ10 7ET")]),
    ("to Flat 4, 62b High Street\nQuenton\nAB1 2CD now", [("address", "Flat 4, 62b High Street\nQuenton\nAB1 2CD")]),
    ("104 saltmarsh rd, osterleigh, oq3 5fn with", [("address", "104 saltmarsh rd, osterleigh, oq3 5fn")]),
    ("Anschrift: Müllerstr. 24a, 04031 Talwinkel", [("address", "Müllerstr. 24a, 04031 Talwinkel")]),
    ("au 17 bis impasse des Tilleuls, 96564 Montclos.", [("address", "17 bis impasse des Tilleuls, 96564 Montclos")]),
    ("en Calle del Olmo nº 14, 3º A, 53867 Villanera. La", [("address", "Calle del Olmo nº 14, 3º A, 53867 Villanera")]),
    ("Mrs Brown and Dr. Anna Brown-Smith", [("name", "Brown"), ("name", "Anna Brown-Smith")]),
    ("BROWN, Anna wrote; ewan brown too; J. R. Brown as well", [("name", "BROWN, Anna"), ("name", "ewan brown"), ("name", "J. R. Brown")]),
    ("Herr Jürgen Brandt und D.ª Íñigo Olmo, Mme Héloïse Lac", [("name", "Jürgen Brandt"), ("name", "Íñigo Olmo"), ("name", "Héloïse Lac")]),
    ("Name: Zelda Crump\nTenant: Mrs Crump and so on", [("name", "Zelda Crump"), ("name", "Crump")]),
    ("Call Anna&nbsp;Brown now", [("name", "Anna&nbsp;Brown")]),
]


@pytest.mark.parametrize("text, want", CASES, ids=range(len(CASES)))
def test_items(text, want):
    assert sorted(found(text)) == sorted(want)


DECOYS = [
    "Meter K10A 1540697 read 68290, then 86634. MPAN 10 1713 5888 426. Order 258-148299. Batch 4019789-37. Code 077832368.",
    "For the rebate I gave account 859520113. Reading list: 32922 10231 24511 24912 20413.",
    "Please reply to the engineer @ the depot. User @flat22 at 14:30 on 2012-04-06. The rate is 3.47p @ slot 14.",
    "Quillcroft Estates and Brown Energy Trust say so. The fault is near the Plover Avenue substation, 2 metres down.",
    "Le poste de la rue des Tanneurs a été contrôlé. Bestellung 349-651295 kam nie an. Household MAC004642.",
    "",
    "   \n",
    "&nbsp;" * 50,
]


@pytest.mark.parametrize("text", DECOYS, ids=range(len(DECOYS)))
def test_decoys(text):
    assert found(text) == []


def test_feistel_is_a_permutation():
    for n in (2, 10, 26, 1000, 1001):
        assert sorted(P.feistel(i, n, b"k") for i in range(n)) == list(range(n))
    assert [P.feistel(i, 1000, b"k") for i in range(50)] != [P.feistel(i, 1000, b"other") for i in range(50)]


def test_pseudonyms_are_linked_and_keep_the_format():
    a, b = P.pseudonym("07700 900123", "phone", b"k"), P.pseudonym("07700.900.123", "phone", b"k")
    assert "".join(c for c in a if c.isdigit()) == "".join(c for c in b if c.isdigit()) and (a[12], b[12]) == (" ", ".") and "900123" not in a
    assert P.pseudonym("A.B@x.test", "email", b"k") == P.pseudonym("a.b (at) x dot test", "email", b"k") != P.pseudonym("a.c@x.test", "email", b"k")
    assert P.pseudonym("BROWN, Anna", "name", b"k") == P.pseudonym("Anna  Brown", "name", b"k")
    n, letter = P.pseudonym("12345678-Z", "identity", b"k")[10:18], P.pseudonym("12345678Z", "identity", b"k")[18]
    assert P.DNI_LETTERS[int(n) % 23] == letter


def test_notations_of_one_number_get_one_pseudonym():
    written = ("+44 7911 123456", "0044 7911 123456", "07911 123456", "+44 (0)7911 123456", "(07911) 123456")
    new = [P.pseudonym(x, "phone", b"k")[7:-1] for x in written]
    assert len({P.canonical_item(x, "phone") for x in new}) == 1 and P.canonical_item(new[0], "phone") != P.canonical_item(written[0], "phone")
    assert new[0].startswith("+44 7") and new[1].startswith("0044 7") and new[2].startswith("07") and new[3].startswith("+44 (0)7")
    assert P.pseudonym("07911 123457", "phone", b"k")[7:-1] != new[2] != P.pseudonym("07911 123456", "phone", b"z")[7:-1]


def test_validated_numbers_stay_valid_and_distinct():
    rng = random.Random(3)
    made = defaultdict(set)
    for i in range(300):
        pair = rng.choice(S.NINO_PREFIXES)
        body = f"{rng.choice('12')}{rng.randrange(100):02d}{rng.randint(1, 12):02d}{rng.choice(S.DEPARTMENTS)}{rng.randint(1, 999):03d}{rng.randint(1, 999):03d}"
        n = rng.randrange(10**8)
        tax = next(x for x in iter(lambda: rng.randrange(10**9, 10**10), None) if S._tax_body(x))
        pension = f"65{rng.randint(1, 28):02d}{rng.randint(1, 12):02d}{rng.randrange(100):02d}{chr(65 + rng.randrange(26))}{rng.randrange(100):02d}"
        province = rng.randrange(10**10)
        for kind, item in (
            ("nino", f"{pair}{rng.randrange(10**6):06d}{rng.choice('ABCD')}"),
            ("insee", f"{body}{S._insee_key(body):02d}"),
            ("dni", f"{n:08d}{S.DNI_LETTERS[n % 23]}"),
            ("tax", f"{tax}{S._tax_check(str(tax))}"),
            ("pension", f"{pension}{S._pension_check(pension)}"),
            ("nuss", f"{province:010d}{province % 97:02d}"),
            ("licence", f"MORGA{rng.randrange(10)}{rng.choice([0, 50]) + rng.randint(1, 12):02d}{rng.randint(1, 28):02d}{rng.randrange(10)}S9{rng.randrange(10)}IJ"),
        ):
            new = S.identity_number(item, b"k")
            assert len(new) == len(item) and S.identity_number(item, b"k") == new
            made[kind].add((item, new))
            if kind == "nino":
                assert new[:2] in S.NINO_PREFIXES and new[8] in "ABCD"
            elif kind == "insee":
                assert new[0] in "12" and 1 <= int(new[3:5]) <= 12 and int(new[13:]) == S._insee_key(new[:13])
            elif kind == "dni":
                assert S.DNI_LETTERS[int(new[:8]) % 23] == new[8]
            elif kind == "tax":
                assert S._tax_body(int(new[:10])) and S._tax_check(new[:10]) == int(new[10])
            elif kind == "pension":
                assert dt.date(2000, int(new[4:6]), int(new[2:4])) and S._pension_check(new[:11]) == int(new[11])
            elif kind == "nuss":
                assert int(new[:10]) % 97 == int(new[10:])
            else:
                assert new[11 + 1] == "9" and int(new[6:8]) % 50 in range(1, 13) and 1 <= int(new[8:10]) <= 31
    for pairs in made.values():
        assert len({b for _, b in pairs}) == len({a for a, _ in pairs}) and sum(a != b for a, b in pairs) >= 0.95 * len(pairs)
    wrong = S.identity_number("217036930399400", b"k")
    assert wrong[0] in "12" and 1 <= int(wrong[3:5]) <= 12


def test_birth_dates_stay_dates():
    for text, item in (("Date of birth: 05/11/1962, thanks", "05/11/1962"), ("geb. am 5.3.71", None), ("née le 17-02-1950", "17-02-1950"), ("DOB 1980-02-29.", "1980-02-29"), ("born 31/02/1980", "31/02/1980"), ("visited 05/11/2013", None)):
        spans = P.with_birth_dates(text, [])
        assert [text[a:b] for a, b, _ in spans] == ([item] if item else [])
        if item and item != "31/02/1980":
            new = P.redact(text, spans, b"k").split("[DATE ")[1].split("]")[0]
            assert len(new) == len(item) and new != item and S.birth_date(new, b"k") is not None
    assert P.redact("born 31/02/1980", P.with_birth_dates("born 31/02/1980", []), b"k") != "born 31/02/1980"


def test_items_run_to_their_own_end():
    blanks, domain = " " * 60, "mail" * 30
    assert ("phone", "555 012 367") in found(f"mi teléfono:{blanks}555 012 367.")
    assert ("name", "Zelda Crump") in found(f"from Zelda Crump <z.crump@{domain}.example.org> today")
    assert ("identity", "AB1234567") in found(f"passport number:{blanks * 3}AB1234567")


def test_the_key_is_the_sessions(spark):
    docs = spark.createDataFrame([(1, "call 07700 900123")], "doc_id long, text string")
    a, b = (P.personal_items(docs, frozenset(), key=k, redacted=True).first()["text"] for k in (b"one", b"two"))
    own = [P.personal_items(docs, frozenset(), redacted=True).first()["text"] for _ in range(2)]
    assert a != b and own[0] == own[1] and own[0] not in (a, b)


def test_random_texts_with_planted_items():
    rng = random.Random(0)
    plain = ["the meter was read", "nothing arrived", "42 times", "slot 7", "see page 3"]
    items = [x for _, want in CASES for x in want if x[0] in ("email", "phone", "identity") and "at" not in x[1]]
    for _ in range(200):
        kind, item = rng.choice([x for x in items if x[1].startswith(("+", "0", "(", "anna"))])
        text = f"{rng.choice(plain)}, {item}; {rng.choice(plain)}"
        assert (kind, item) in found(text)


def test_distributed(spark):
    rows = [(1, "Name: Zelda Crump\nTel: 07700 900123", "t"), (2, "Signed: Zelda Crump", "t"), (3, None, "t"), (4, "", "t"), (5, "zelda crump of 3 Elm Road\n" + "x " * 200_000 + "call 07700 900123", "t"), (5, "zelda crump, zelda crump", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pii_type string")
    assert P.learn_given_names(df) == {"zelda"}
    got = sorted((r["doc_id"], r["pii_type"], r["pii_text"]) for r in P.personal_items(df).collect())
    assert got == [(1, "name", "Zelda Crump"), (1, "phone", "07700 900123"), (2, "name", "Zelda Crump"), (5, "address", "3 Elm Road"), (5, "name", "zelda crump"), (5, "name", "zelda crump"), (5, "phone", "07700 900123")]
    clean = {(r["doc_id"], r["n_items"]): r["text"] for r in P.personal_items(df, redacted=True).collect()}
    assert clean[3, 0] is None and clean[4, 0] == "" and clean[1, 2].startswith("Name: [NAME ") and "Crump" not in clean[1, 2]
    assert P.personal_items(df.limit(0)).collect() == []


def test_prefilters_are_no_narrower_than_their_patterns():
    given = frozenset(["nadia"])
    want = {
        "Ich wohne Am Lindenhof 12, 50667 Köln.": ("address", "Am Lindenhof 12, 50667 Köln"),
        "Wir wohnen An der Mühle 7a seit Mai": ("address", "An der Mühle 7a"),
        "Chez moi, 12 rue&nbsp;Pasteur": ("address", "12 rue&nbsp;Pasteur"),
        "My ID card: AB1234567": ("identity", "AB1234567"),
        "NI: 99 88 77 66": ("identity", "99 88 77 66"),
        "write to anna\xa0at\xa0example.org": ("email", "anna\xa0at\xa0example.org"),
        "seen with [Nadia Corvell], ok": ("name", "Nadia Corvell"),
        "said 'Nadia Corvell' once": ("name", "Nadia Corvell"),
    }
    got = {t: [(k, t[a:b]) for a, b, k in P.find_items(t, given)] for t in want}
    assert got == {t: [x] for t, x in want.items()}
    assert P.find_items("Im Januar 2014 und Am Montag 12 Uhr", given) == []


def test_names_beyond_the_cap_are_joined_not_dropped(spark):
    texts = ["Name: Nadia Corvell\n", "Name: Nadia Brook\nand more", "Name: Tomek Hale\n", "Name: Tomek Lind\nyes", "we met tomek harrow and nadia voss today", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    few, many = P.learn_given_names(docs), P.learn_given_names(docs, most=1)
    assert few == {"nadia", "tomek"} and {r["given"] for r in many.collect()} == few
    for redacted in (False, True):
        a, b = ({tuple(r) for r in P.personal_items(docs, g, redacted=redacted).collect()} for g in (few, many))
        assert a == b and a
    assert (4, "name", "tomek harrow") in {tuple(r) for r in P.personal_items(docs, many).collect()}
