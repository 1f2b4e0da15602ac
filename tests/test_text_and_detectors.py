import html
import html.entities

import pytest
from pyspark.sql import functions as F

from docketry import catalog as C
from docketry.functions import detectors as D
from docketry.functions import text as T


def one(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").repartition(2)
    return [r["r"] for r in rows.select("i", fn(F.col("t")).alias("r")).orderBy("i").collect()]


def originals(spark, values, fn):
    return [r["original"] for r in one(spark, values, fn)]


def normals(spark, values, fn):
    return [r["normalized"] for r in one(spark, values, fn)]


def test_digit12(spark):
    texts = [
        "no 123456789012 here", "1234 5678 9012", "1234-5678-9012", "1234-5678 9012", "1234/5678.9012",
        "1234567890123456", "a123456789012", "é123456789012", "12345678901", "", None,
        "1234 5678 9012 then 999988887777",
    ]
    assert originals(spark, texts, D.detect_digit12) == [
        "123456789012", "1234 5678 9012", "1234-5678-9012", "1234-5678 9012", "1234/5678.9012",
        # the loose form has no boundaries: it fires inside longer runs and after letters
        "123456789012", "123456789012", "123456789012", None, None, None,
        # a contiguous number anywhere beats a grouped one before it
        "999988887777",
    ]
    assert normals(spark, ["1234-5678 9012"], D.detect_digit12) == ["123456789012"]


def test_account11(spark):
    texts = [
        "12345678901", "123 4567 8901", "123-4567-8901", "192.168.100.200", "12.34.56.78", "123456789012",
        "x 152.143.12.131", None, "",
    ]
    assert originals(spark, texts, D.detect_account11) == [
        "12345678901", "123 4567 8901", "123-4567-8901", None, None, None, "152.143.12.131", None, None,
    ]


def test_pan(spark):
    texts = [
        "abcde1234f", "ABCDE 1234 F", "ABCDE-1234-F", "ABCDE1234", "xABCDE1234F", "éABCDE1234F", "zzABCDE1234F",
        "ABCDE1234F1", None, "",
    ]
    assert normals(spark, texts, D.detect_pan) == [
        "ABCDE1234F", "ABCDE1234F", "ABCDE1234F", None,
        # no boundary, and the first ten characters of the run are not a number of this kind
        None, "ABCDE1234F", None, "ABCDE1234F", None, None,
    ]


def test_pan_failed_validation_moves_on(spark):
    # the Kelvin sign counts as a letter when case is ignored, but does not survive validation
    assert normals(spark, ["KBCDE1234F and ABCDE-1234-Z"], D.detect_pan) == [None]


def test_voter(spark):
    phrase = "ELECTION COMMISSION OF INDIA"
    texts = [
        "id abc1234567 x", phrase + " AB12345", "Elector's Name QW123456", "nothing QW123456", "x" * 3, None,
        " " * 200 + "Elector Name" + " " * 200 + "QW123456",
    ]
    got = normals(spark, texts, D.detect_voter)
    assert got[0] == "ABC1234567"
    # words of the phrase itself are long enough to be taken for a code
    assert got[1] == "ELECTION"
    assert got[2] == "QW123456"
    assert got[3] is None and got[4] is None and got[5] is None
    # the code is more than 120 characters away
    assert got[6] is None


def test_voter_v1_accepts_pan_shapes(spark):
    fn = lambda c: D.detect_voter(c, "v1")
    assert normals(spark, ["ABC1234567", "abcde-1234-f", "zzABCDE1234F"], fn) == ["ABC1234567", "ABCDE1234F", None]


@pytest.mark.parametrize(
    "text,field,value",
    [
        ("this Male here", "male_value", "Male"), ("Sex: M", "male_value", "M"), ("Gender M", "male_value", "M"),
        ("Female", "male_found", False), ("émale", "male_found", False),
        ("DOB 12/07/1985", "dob_text", "12/07/1985"), ("DOB 1985-07-12", "dob_text", "1985-07-12"),
        ("born 12-Jul-1985", "dob_text", "12-Jul-1985"), ("DOB 12-Jul-1985", "dob_text", None),
        ("DOB", "dob_found", True), ("1985-07-12", "dob_found", False),
        ("GOVERNMENT OF INDIA", "issuer_found", True), ("uidai", "authority_found", True),
        ("Address :", "address_found", True), ("Addresses", "address_found", False),
        ("S/O x", "relation_found", True), ("son of x", "relation_found", True), ("on of x", "relation_found", False),
        ("so", "relation_found", True), ("sofa", "relation_found", False),
    ],
)
def test_components(spark, text, field, value):
    assert one(spark, [text], D.id_components)[0][field] == value


def test_component_versions(spark):
    v14 = lambda c: D.id_components(c, "v14")
    v11 = lambda c: D.id_components(c, "v11")
    assert one(spark, ["on of x"], v14)[0]["relation_found"] is True
    assert one(spark, ["son of x"], v14)[0]["relation_found"] is False
    assert one(spark, ["DOB 12-Jul-1985"], v14)[0]["dob_text"] == "12-Jul-1985"
    assert one(spark, ["DOB 1985-07-12"], v11)[0]["dob_text"] is None
    assert one(spark, ["DOB 1985-07-2"], v11)[0]["dob_text"] == "1985-07-2"


def test_side(spark):
    side = lambda c: D.id_side(D.id_components(c))
    rows = one(spark, ["Male", "Male DOB", "Male DOB Address", "Address", ""], side)
    assert [(r["front"], r["back"], r["both"]) for r in rows] == [
        (False, False, False), (True, False, False), (True, True, True), (False, True, False), (False, False, False)
    ]
    always = lambda c: D.id_side(D.id_components(c), "v5")
    assert one(spark, [""], always)[0]["both"] is True


def test_noise(spark):
    lines = [
        "[12, 34] (5)", "(hello) world", "conf: 0.98", "Conf: 0.98", "99.5", "12:30 - 14", "नमस्ते [1]", "  a   b ", "a b",
        "{[()]}", "é [1]", "<b>x</b>",
    ]
    df = spark.createDataFrame([(lines,)], "l array<string>").select(T.drop_ocr_noise(F.col("l")).alias("r"))
    # the accented letter is outside both alphabets, so that line is bracket noise
    assert df.first()["r"] == ["hello world", "Conf: 0.98", "नमस्ते 1", "a b", "x"]


def test_markup_and_entities(spark):
    raw = "<p>a&amp;lt; b &#233; &#x1F600; &quot;q&quot; &unknown; &<BR/> c <br >&copy; d</p>"
    got = one(spark, [raw], T.strip_markup)[0]
    assert got == ["a&lt; b é 😀 \"q\" &unknown; &", "c", "© d"]
    assert got[0] == html.unescape("a&amp;lt; b &#233; &#x1F600; &quot;q&quot; &unknown; &")
    odd = "&#0; &#99999999999; &#xD800; &#x10FFFF; &#0065; &#x041; &#128; &#x81; &#7; &#11; &#13; &#xFDD0; &#xFFFE; &#x1F600;"
    assert one(spark, [odd], T.unescape)[0] == html.unescape(odd)
    odd = ["caf&eacute; &Auml; &hearts; it&#39 s &amp x", "&notit; &notin; &copyright &#x41 &#xZ &# &#; &; & &&lt; &NotEqualTilde;", "&acE;&Aacutex &gtx &GT &sup1 &x;"]
    assert one(spark, odd, T.unescape) == [html.unescape(s) for s in odd]
    assert one(spark, ["".join("&" + n for n in sorted(html.entities.html5))], T.unescape) == [html.unescape("".join("&" + n for n in sorted(html.entities.html5)))]


def test_match_lines(spark):
    assert one(spark, ["a b\r\n\r\n c.d,e\n a  b"], T.match_lines)[0] == ["a b", "c.d,e", "a b c", "d", "e a b"]
    as_is = lambda c: T.match_lines(c, split_short=False)
    assert one(spark, ["a.b\na.b\n c"], as_is)[0] == ["a.b", "c"]
    assert one(spark, ["1\n2\n3\n4\n5.6"], T.match_lines)[0] == ["1", "2", "3", "4", "5.6"]


def test_names(spark):
    names = ["a.b.PNG", ".bashrc", "..x.y", "plain", "sp ace.Tif"]
    assert one(spark, names, T.stem) == ["a.b", ".bashrc", "..x", "plain", "sp ace"]
    assert one(spark, names, T.extension) == ["png", "bashrc", "y", "png", "tif"]
    assert one(spark, ["a b#c.png"], T.clean_filename) == ["a_b_c.png"]


def test_payload_round_trip(spark):
    text = "x" * 200
    uri = lambda c: T.encode_data_uri(F.encode(c, "UTF-8"), F.lit("png"))
    back = lambda c: T.decode_payload(uri(c)).cast("string")
    assert "\n" not in one(spark, [text], uri)[0]
    assert one(spark, [text], back) == [text]
    assert one(spark, ["aGk="], lambda c: T.decode_payload(c).cast("string")) == ["hi"]


def test_plain_pattern(spark):
    got = one(spark, [r"\bpan\b", r"\b[A-Z]{3}\d{7}\b", "Elector's Name"], T.plain_pattern)
    assert got == ["pan", "A Z 3 d 7", "Elector s Name"]


def test_first_text_and_min_text(spark):
    df = spark.createDataFrame([("  ", None, " x ")], "a string, b string, c string")
    assert df.select(T.first_text(F.col("a"), F.col("b"), F.col("c"))).first()[0] == "x"
    assert one(spark, ["abc ", "abcd", None, " ab "], T.min_text) == [False, True, False, False]
