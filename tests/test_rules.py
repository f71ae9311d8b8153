"""Rules of small functions, case by case, and the entry without its optional part."""

import subprocess
import sys

from pyspark.sql import functions as F

from conftest import ROOT
from lodestone.functions import bodies, text
from lodestone.operators import images
from lodestone.sources import scripts, textfiles


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first().x


def test_addresses_in_every_spelling(spark):
    at = lambda v: [int(x) for x in one(spark, text.address_candidates, v)]
    assert at("0x40a1c0") == at("0040a1c0") == at("FUN_0040a1c0") == at(" 40A1C0 ") == [0x40A1C0]
    assert at("4235712") == [0x4235712, 4235712] and at("0x4235712") == [0x4235712] and at("0") == [0]
    assert at("ffffffff80001000") == [0xFFFFFFFF80001000] and at("fun_10") == [16]
    assert at("main") == at("") == at("1" * 21) == [] and at("18446744073709551616") == []


def test_templates_that_cannot_be_decided(spark):
    pattern = lambda v: one(spark, text.template_pattern, v)
    assert pattern("a%%d") == "^a%d$" and pattern("%5.2lu%%") == "^[0-9]+%$" and pattern("w.%s") == r"^w\..+$"
    assert pattern("a%q") is None and pattern("100%") is None and pattern("<built:strcpy>") is None
    anchored = lambda v: one(spark, text.template_anchored, v)
    assert anchored("wl%d_ssid") and not anchored("%s %d\t") and not anchored("<built:strcpy>") and not anchored("a%s")


def test_form_fields_keep_what_a_form_sends(spark):
    html = """<input type=submit name="go"><input type='image' name=pic><input type=hidden name=h><input type=button name=b><input type=reset name=r>
    <input name="u" type="text"><script>document.form.k1.value = 3; nvram_char_to_ascii("wan", "k2")</script>"""
    got = textfiles.form_fields(spark.createDataFrame([("p", html), ("q", None)], "path string, text string"))
    assert sorted((r.field, r.rule) for r in got.collect()) == [("go", "input"), ("k1", "js_form_assign"), ("k2", "nvram_char_to_ascii"), ("pic", "input"), ("u", "input")]


def test_pages_are_filled_line_by_line(spark):
    body = ("x" * 29 + "\n") * 3 + "y" * 90 + "\nz"
    got = textfiles.line_pages(spark.createDataFrame([("p", body), ("q", None), ("r", "")], "path string, text string"), 40).orderBy("page").collect()
    assert [(r.first_line, r.lines, len(r.text)) for r in got] == [(0, 1, 30), (1, 1, 30), (2, 1, 30), (3, 1, 91), (4, 1, 1)]


def test_wide_words_and_zsh(spark):
    blocks = spark.createDataFrame([("b", 0, bytes.fromhex("0010008000000ff0ffffffffffffffff"))], "binary string, address long, data binary")
    assert [int(r.value) for r in images.words(blocks, 8).orderBy("address").collect()] == [0xF00F000080001000, 2**64 - 1]
    assert one(spark, scripts.shell_command, 'zsh -c "/bin/run x"').first_word == "/bin/run"


def test_a_difference_of_any_size():
    a = [f"line {i}" for i in range(3000)]
    b = [*a[:5], *(f"other {i}" for i in range(2990)), *a[2995:]]
    got = bodies.text_delta("\n".join(a), "\n".join(b))
    assert got["state"] == "too_large" and got["removed"] == got["added"] == 2990 and got["hunks"][0]["a"].startswith("line 5\n")
    small = bodies.text_delta("a\nb\nc\nd", "a\nx\nc\nd")
    assert (small["state"], small["ratio"], small["hunks"]) == ("substitution", 0.75, [{"a": "b", "b": "x"}])
    assert bodies.text_delta("a\na", "a\na\na")["added"] == 1


def test_the_core_stands_without_what_the_rest_needs():
    code = "import sys; sys.modules['tiktoken'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, len(e.oracle_sql()) > 30)"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    n, ops, pipeline, known = out.stdout.split()
    assert int(n) >= 39 and (ops, pipeline, known) == ("0", "False", "True"), out.stderr
