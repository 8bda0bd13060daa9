from conftest import rows
from pyspark.sql import functions as F

from custodia.functions import naming, text, values, wire


def one(spark, value, column, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(column(F.col("x")).alias("y")).first()["y"]


def test_text_values(spark):
    assert one(spark, " \t a b \n", values.str_or_null) == "a b"
    assert one(spark, "   ", values.str_or_null) is None
    assert one(spark, None, values.str_or_null) is None
    for word, meaning in {"TRUE": True, " yes ": True, "1": True, "No": False, "0": False, "false": False, "2": None, "": None}.items():
        assert one(spark, word, values.bool_or_null) is meaning
    for number, meaning in {"12": 12, " -3 ": -3, "+5": 5, "1_000": 1000, "1.5": None, "x": None, "": None, "9" * 30: None}.items():
        assert one(spark, number, values.int_or_null) == meaning


def test_lists(spark):
    assert one(spark, " a, ,b ,", values.parse_list) == ["a", "b"]
    assert one(spark, None, values.parse_list) == []
    assert one(spark, "1, 2", values.parse_int_list) == [1, 2]
    assert one(spark, "1, two", values.parse_int_list) == []


def test_variant_values(spark):
    record = '{"i":7,"f":-1.9,"t":true,"s":" 12 ","w":"x","n":null,"l":["a",1,null,true],"o":{"k":1},"yes":"Yes","b":"  "}'
    df = spark.createDataFrame([(record,)], "j string").select(F.parse_json("j").alias("v"))

    def get(key, fn):
        return df.select(fn(values.field(F.col("v"), key)).alias("y")).first()["y"]

    assert [get(k, values.variant_int) for k in ("i", "f", "t", "s", "w", "n", "missing")] == [7, -1, 1, 12, None, None, None]
    assert [get(k, values.variant_bool) for k in ("t", "yes", "i", "w", "n")] == [True, True, None, None, None]
    assert [get(k, values.variant_str) for k in ("s", "b", "i", "t", "n", "missing")] == ["12", None, "7", "True", None, None]
    assert get("l", values.variant_str_array) == ["a", "1", "None", "True"]
    assert get("w", values.variant_str_array) == ["x"]
    assert get("i", values.variant_str_array) == [] and get("missing", values.variant_str_array) == []


def test_prefixed_entries(spark):
    df = spark.createDataFrame(
        [('{"annotation_stats#1":{"c":2},"annotation.z":3,"annotations":"[]"}',), ('{"annotations":"[]"}',)], "j string"
    )
    got = [r[0] for r in df.select(values.prefixed_json(F.parse_json("j"), wire.ANNOTATION_PREFIXES)).collect()]
    assert got == ['{"annotation.z":3,"annotation_stats#1":{"c":2}}', None]


def test_entitled_emails(spark):
    entries = ['{"email":"a@x"}', "broken", '{"name":"n"}', '{"email":""}', '["email"]', '{"email":"b@x"}']
    assert one(spark, entries, values.entitled_emails, "array<string>") == ["a@x", "b@x"]
    assert one(spark, None, values.entitled_emails, "array<string>") == []
    mixed = spark.createDataFrame([('["{\\"email\\":\\"a@x\\"}", {"email":"b@x"}, 5, {"email":null}]',)], "j string")
    assert mixed.select(values.variant_entitled_emails(F.parse_json("j"))).first()[0] == ["a@x", "b@x"]
    structs = spark.createDataFrame([([("a@x",), (None,), ("",)],)], "e array<struct<email:string>>")
    assert structs.select(values.entitled_emails_struct(F.col("e"))).first()[0] == ["a@x"]


def test_extracted_attribute(spark):
    get = lambda c: values.extracted_attr(c, "employee_id")
    assert one(spark, '{"employee_id":"E1"}', get) == "E1"
    assert one(spark, "not json", get) is None
    assert one(spark, '{"other":1}', get) is None


def test_slugs(spark):
    assert one(spark, "Unstructured Datasets", naming.slug) == "unstructured-datasets"
    assert one(spark, " HR / Finance  ", naming.slug) == "hr-finance"
    assert one(spark, " -- ", naming.slug) == "unnamed"
    assert one(spark, None, naming.slug) == "unnamed"
    assert one(spark, "a" * 200, naming.slug) == "a" * 90
    assert one(spark, "x", naming.normalize_ref) == "xxx"
    assert one(spark, "b" * 50, naming.normalize_ref) == "b" * 36


def test_collection_refs(spark):
    df = spark.createDataFrame(
        [("Finance Share", "42"), ("", "7"), ("N" * 60, "12345"), ("share", "i" * 40), ("ab-", "1" * 33), ("x", "")], "n string, i string"
    )
    got = [r[0] for r in df.select(naming.collection_ref(F.col("n"), F.col("i"))).collect()]
    import hashlib

    short = hashlib.sha1(("i" * 40).encode()).hexdigest()[:8]
    assert got == ["finance-share-42", "unnamed-7", "n" * 30 + "-12345", f"share-{short}", "ab-" + "1" * 33, "x-x"]
    assert all(3 <= len(ref) <= 36 for ref in got)


def test_group_refs(spark):
    assert one(spark, "parent", naming.group_ref) == "unstructured-datasets-parent"
    assert one(spark, "p" * 30, naming.group_ref) == "unstr-" + "p" * 30
    long = one(spark, "p" * 40, naming.group_ref)
    assert long == "unstructured-datasets-" + "p" * 40


def test_qualified_names(spark):
    df = spark.createDataFrame([("acme", "999")], "t string, i string")
    got = df.select(naming.tag_qn(F.col("t"), F.col("i")), naming.datasource_qn(F.col("t"), F.col("i"))).first()
    assert tuple(got) == ("dxrtag://acme/999", "dxrds://acme/999")
    assert one(spark, "dxrds://acme/7", naming.qn_tenant) == "acme"
    assert one(spark, "dxrds://acme/7", naming.qn_id) == "7"
    assert one(spark, "no name", naming.qn_tenant) == "default"
    assert one(spark, "no name", naming.qn_id) == ""


def test_links(spark):
    assert naming.base_url(" host.example.com/ ") == "https://host.example.com"
    assert naming.base_url("http://h/") == "http://h"
    link = lambda c: naming.abs_link("h", c)
    assert one(spark, "/a?b", link) == "https://h/a?b"
    assert one(spark, "", link) is None and one(spark, None, link) is None


def test_paths_and_keys(spark):
    assert one(spark, "a/b/c.txt", naming.basename) == "c.txt"
    assert one(spark, "c.txt", naming.basename) == "c.txt"
    assert one(spark, "\\\\srv\\share\\d\\f.docx", naming.leaf_name) == "f.docx"
    assert one(spark, "/a/b/", naming.leaf_name) == "b"
    assert one(spark, "in+box%2Fa%20b%zz%", naming.decode_key) == "in box/a b%zz%"


def test_tokens_rebuild_the_text(spark):
    for body in ("", "  one two\n\tthree  ", "x", "a\n\n\nb ", "été à"):
        assert "".join(one(spark, body, text.tokens)) == (body if body.strip() else "")
    assert one(spark, "a b c", text.token_count) == 3
    assert one(spark, "a b c", lambda c: text.truncate_tokens(c, 2)) == "a b"
    assert one(spark, "a b ", lambda c: text.truncate_tokens(c, 2)) == "a b "
    by_letter = lambda c: F.split(c, "")
    assert one(spark, "abcd", lambda c: text.truncate_tokens(c, 3, by_letter)) == "abc"


def test_preview_blank_groups(spark):
    assert one(spark, "abc" * 200, text.preview) == ("abc" * 200)[:300]
    assert [one(spark, x, text.is_blank) for x in (None, "  \n", "a")] == [True, True, False]
    assert one(spark, ["a", "b"], text.joined_groups, "array<string>") == "a,b"
    assert one(spark, None, text.joined_groups, "array<string>") == ""


def test_rows_helper(spark):
    assert rows(spark.createDataFrame([(2,), (1,)], "a int")) == [(1,), (2,)]


def test_all_white_space_is_stripped(spark):
    spaces = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    assert one(spark, spaces + "é" + spaces, values.str_or_null) == "é"
    assert one(spark, spaces, values.str_or_null) is None and one(spark, spaces, text.is_blank)
