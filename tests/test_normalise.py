import hashlib
import pytest
from linkspark.functions.address import with_addresses
from linkspark.functions.text import romanise, with_names

# fixed inputs, whose results are known
WORDS = {"लक्ष्मी": "laxmi", "इन्वेस्टमेंट": "investment", "प्रा": "pvt", "लि": "ltd"}


def names(spark, rows):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, raw string")
    return [r.asDict() for r in with_names(df, "raw", WORDS).orderBy("k").collect()]


def test_name_noise(spark):
    cases = [
        ("Drexnexarc dba Highland Capital, LLC", {"n_core": "highland capital", "has_alias": 1, "n_alias": "drexnexarc"}),
        ("-- Holloway Peak Inc", {"n_core": "holloway peak"}),
        ("Kinley Pediatrics L.L.C.", {"n_full": "kinley pediatrics llc"}),
        ("Integrated Trading Ass0ciates", {"n_core": "integrated trading associates"}),
        ("M/s LAXMI INVESTMENT PVT LTD.", {"n_core": "laxmi investment", "n_legal": "ltd pvt"}),
        ("wilfordhancock.com", {"n_cmp": "wilfordhancock", "is_domain": 1, "has_alias": 0}),
        ("PLANTATION CENTER PRIVATE LÍMITED (ID: 93609)", {"n_full": "plantation center pvt ltd"}),
        ("लक्ष्मी इन्वेस्टमेंट प्रा. लि.", {"n_core": "laxmi investment", "is_native": 1}),
        ("Mountain Mountain Best", {"n_core": "mountain best"}),
        ("The Center", {"n_core": "the center"}),
        ("", {"n_full": "", "n_core": "", "n_cmp": "", "is_domain": 0}),
        (None, {"n_full": "", "n_core": ""}),
    ]
    for (raw, wanted), got in zip(cases, names(spark, [c[0] for c in cases]), strict=True):
        assert {k: got[k] for k in wanted} == wanted, raw


def test_unknown_native_words_are_romanised(spark):
    assert names(spark, ["सन"])[0]["n_core"] != ""
    assert romanise("कमल") == "kamala"


@pytest.mark.parametrize(
    "raw, country, wanted",
    [
        ("#111 Mansfield Ave, Shelby, Ohio", "US", {"a_street": "mansfield ave", "a_loc": "shelby", "a_state": "oh", "a_house": "111"}),
        ("31, Mumbai City, महाराष्ट्र", "India", {"a_state": "maharashtra", "a_house": "31"}),
        ("TN", "India", {"a_state": "tamil nadu", "a_norm": ""}),
        ("12 R. Lyderic, Lille, Nord", "France", {"a_state": "hauts de france", "a_street": "rue lyderic"}),
        ("D-12, Kalkaji, New Delhi, Delhi", "India", {"a_ids": "d12", "a_state": "delhi"}),
        ("12 Main St, New York, NY", "US", {"a_loc": "", "a_state": "ny"}),
        ("0012 12th Street, PO Box 55, N/A, Dallas, TX", "US", {"a_nums": "12", "a_house": "12", "a_street": "12th st"}),
        ("44600 St Nazaire, Loire Atlantique", "France", {"a_loc": "st nazaire", "a_street": "", "a_nums": "44600"}),
        ("22/235 Poona Road, Bombay", "India", {"a_ids": "22/235", "a_nums": "22 235", "a_loc": "mumbai"}),
        ("", "US", {"a_empty": 1, "a_norm": ""}),
        (None, None, {"a_empty": 1, "a_state": ""}),
    ],
)
def test_addresses(spark, raw, country, wanted):
    df = spark.createDataFrame([(raw, country)], "raw string, country string")
    got = with_addresses(df, "raw", "country").first().asDict()
    assert {k: got[k] for k in wanted} == wanted


def test_accents_are_stripped_in_every_row(spark, tmp_path):
    from linkspark.plans.queries import QUERIES

    rows = [(1, "Größe Äpfel", "de"), (2, "Éa", "fr"), (3, "Ü", None), (4, None, "de")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n, r.digest) for r in QUERIES["norm_accents"](spark, str(tmp_path)).collect()}
    digest = lambda x: (len(x), hashlib.md5(x.encode()).hexdigest())
    assert got == {1: digest("große apfel"), 2: digest("ea"), 3: digest("u"), 4: (None, None)}
