"""Files in, tables out: XML subtitles, CSV labels, word vectors, writers."""

import gzip

import pyarrow as pa
from pyspark.sql import functions as F

from cinegrade.catalog.corpus import _in_elements
from cinegrade.functions import html as H
from cinegrade.functions import xml as X
from cinegrade.functions.text import bag_of_words
from cinegrade.operators.scores import percent_parsed
from cinegrade.plans.ratings import training_rows
from cinegrade.sources import readers, writers

SAMPLE = """<document id="5"><meta><source><genre>Drama</genre><tokens>1</tokens></source>
<conversion><sentences>2</sentences><tokens>5</tokens><corrected>9</corrected></conversion></meta>
<s id="1"><time id="T1S" value="00:00:01,000"/><w id="1.1">Hello</w><w id="1.2">World-wide</w></s>
<s id="2"><w id="2.1">One</w><w id="2.2"/><time id="T1E" value="00:01:02,500"/></s></document>"""
FILES = {
    "en/1968/11.xml": SAMPLE,
    "en/1968/12.xml": "<document><s id='1'><w id='1.1'>Only</w></s></document>",
    "en/1970/13.xml": "<document><meta/></document>",
    "en/1970/14.xml": "<document><s>",
    "en/1971/15.xml": "<document><s id='1'/><s id='2'><w>Late words</w></s></document>",
}


def write_corpus(tmp_path):
    for name, content in FILES.items():
        file = tmp_path / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(content)
    with gzip.open(tmp_path / "en/1971/16.xml.gz", "wt") as f:
        f.write("<document><s id='1'><w>Zipped</w></s></document>")
    (tmp_path / "en/1971/17.xml").write_text("")
    return str(tmp_path / "en")


def test_read_subtitles(spark, tmp_path):
    rows = {r["file_id"]: r for r in readers.read_subtitles(spark, write_corpus(tmp_path)).collect()}
    sample = rows["11"]
    assert [(s["id"], s["times"], s["words"]) for s in sample["sentences"]] == [
        ("1", ["00:00:01,000"], ["Hello", "World-wide"]),
        ("2", ["00:01:02,500"], ["One", ""]),
    ]
    assert sample["meta"] == {"genre": "Drama", "sentences": "2", "tokens": "5"}
    assert [s["words"] for s in rows["12"]["sentences"]] == [["Only"]]
    assert [s["words"] for s in rows["15"]["sentences"]] == [[], ["Late words"]]
    assert [s["words"] for s in rows["16"]["sentences"]] == [["Zipped"]]
    assert {k for k, r in rows.items() if r["corrupted"]} - {"17"} == {"13", "14"}
    assert rows["13"]["reject"] is None and rows["14"]["reject"] is not None


def test_bag_duration_and_share(spark, tmp_path):
    subs = readers.read_subtitles(spark, write_corpus(tmp_path))
    row = subs.where("file_id = '11'").select(
        bag_of_words(F.col("sentences")).alias("bow"), X.duration_seconds(F.col("sentences")).alias("d")
    ).first()
    assert row["bow"] == ["hello", "world-wide", "one"] and row["d"] == 61.5
    files = readers.list_files(spark, str(tmp_path / "en"))
    assert sorted(r["file_id"] for r in files.collect()) == ["11", "12", "13", "14", "15", "16"]
    share = percent_parsed(subs, n_files=len(FILES) + 2).first()[0]
    assert abs(share - 100 * 4 / 7) < 1e-9


def test_training_rows_and_trial_ids(spark, tmp_path):
    path = write_corpus(tmp_path)
    labels = spark.createDataFrame([("11", "R"), ("12", "PG"), ("14", "R"), ("15", "GP")], "file_id STRING, rating STRING")
    rows = training_rows(readers.read_files(spark, path), labels).collect()
    assert {(r["file_id"], r["rating"]) for r in rows} == {("11", "R"), ("12", "NOT_R")}
    assert readers.read_subtitles(spark, path, ["11"]).count() == 1


def test_read_subtitle_records(spark, tmp_path):
    (tmp_path / "many.xml").write_text("<all>" + FILES["en/1968/12.xml"] + SAMPLE + "</all>")
    rows = readers.read_subtitle_records(spark, str(tmp_path)).collect()
    assert sorted(len(r["sentences"]) for r in rows) == [1, 2]


def test_labels_and_predictions_csv(spark, tmp_path):
    (tmp_path / "labels.csv").write_text('IDSubtitle,RATING,TITLE\n11,R,"a, b"\n\n12,PG,c\n')
    labels = readers.read_labels(spark, str(tmp_path / "labels.csv"))
    assert sorted(map(tuple, labels.collect())) == [("11", "R"), ("12", "PG")]
    (tmp_path / "more.csv").write_text('IDSubtitle,RATING\n"1\n1",R\n\n12,"say ""PG"""\n')
    broken = readers.read_labels(spark, str(tmp_path / "more.csv"), multi_line=True)
    assert sorted(map(tuple, broken.collect())) == [("1\n1", "R"), ("12", 'say "PG"')]
    (tmp_path / "pred.csv").write_text("IDSubtitle,sentiment,prediction\n11.0,DRUGS,0.5\n12,SCARY,1\n")
    pred = readers.read_predictions(spark, str(tmp_path / "pred.csv"))
    assert sorted(map(tuple, pred.collect())) == [("11", "DRUGS", 0.5), ("12", "SCARY", 1.0)]


def test_word_vectors(spark, tmp_path):
    (tmp_path / "vectors.txt").write_text("gun 0.5 -1e-3\ndrug 1 2\n\n")
    rows = readers.read_word_vectors(spark, str(tmp_path / "vectors.txt")).collect()
    assert {r["word"]: r["vec"] for r in rows} == {"gun": [0.5, -0.001], "drug": [1.0, 2.0]}


def test_csv_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1968, 'The "Big", one'), (1970, None)], readers.FILMS_SCHEMA)
    writers.write_csv(df, str(tmp_path / "films"))
    back = readers.read_table(spark, str(tmp_path / "films"), readers.FILMS_SCHEMA)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_insert_if_absent_twice(spark, tmp_path):
    path = str(tmp_path / "store")
    schema = "imdb_id STRING, n INT"
    writers.replace_with_batches([spark.createDataFrame([("a", 0)], schema), spark.createDataFrame([], schema)], path)
    new = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2), ("c", 4)], schema)
    for _ in range(2):
        writers.insert_if_absent(spark, new, path, "imdb_id", ["n"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 0), ("b", 2), ("c", 4)]


def test_records_alike_in_order_give_one_result(spark):
    rows = [("a", 1, c) for c in "zyxwv"]
    for parts in (1, 3, 5):
        records = spark.createDataFrame(rows, "imdb_id STRING, n INT, text STRING").repartition(parts, "text")
        assert [tuple(r) for r in writers.first_per_key(records, "imdb_id", ["n"]).collect()] == [("a", 1, "v")]


def test_replace_with_batches_truncates(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = lambda *ns: spark.createDataFrame([(n,) for n in ns], "n INT")
    writers.replace_with_batches([frame(1, 2)], path)
    writers.replace_with_batches([frame(), frame(3), frame(4, 5)], path)
    assert sorted(r[0] for r in spark.read.parquet(path).collect()) == [3, 4, 5]
    writers.replace_with_batches([frame()], path)
    assert spark.read.parquet(path).isEmpty()


def test_find_guides(spark):
    guides = spark.createDataFrame([("1", ["x"], None), ("2", None, None), ("3", None, [])], "imdb_id STRING, a ARRAY<STRING>, b ARRAY<STRING>")
    assert sorted(r["imdb_id"] for r in readers.find_guides(guides, ["a", "b"]).collect()) == ["1", "3"]


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "v STRING").select(make(F.col("v")).alias("out")).first()["out"]


def test_result_page(spark):
    page = (
        '<body><div style="width:1000px;"><span>TITLE</span><span>RATING</span><b>REASON</b></div>'
        '<div class="x" style="width:1000px;"><a href="#">Jaws &amp; Co (1975)</a><span>PG</span><span></span></div>'
        '<div style="width:1000px;"><span>Short</span></div></body>'
    )
    assert one(spark, page, H.result_records) == [
        {"TITLE": "Jaws & Co (1975)", "RATING": "PG", "REASON": ""}, {"TITLE": "Short"},
    ]
    assert one(spark, "<body><p>none</p></body>", H.result_records) == []


GUIDE = """<a class="main" href="/t">The <i>Film</i></a>
<div class="info"><h5>MPAA</h5><div class="c">Rated R for Violence</div></div>
<div class="info"><h5>Certification:</h5><div>USA:R / UK:15 / Usa:PG / West Germany:12:a</div></div>
<div class="section" id="swiki.2.1"><h3>Violence/Gore</h3><div class="display"><ul><li>A fight &#38; a f&#xe9;te</li><li> </li></ul>More<!-- no --></div></div>
<div id="swiki.2.2"><h3>Profanity</h3><div class="display">None</div></div>
<div id="swiki.2.10"><h3>Other</h3><div class="display">x</div></div>"""


def test_guide_page(spark):
    assert one(spark, GUIDE, H.guide_title) == "The Film"
    info = one(spark, GUIDE, H.guide_info)
    assert info["mpaa_reason"] == "rated r for violence"
    assert one(spark, info["certification"], H.certification_map) == {"usa": "pg", "uk": "15", "west_germany": "12:a"}
    record = one(spark, GUIDE, H.guide_record)
    assert record["title"] == "The Film" and record["info"].keys() == {"mpaa_reason"} and record["certification"]["usa"] == "pg"
    assert one(spark, "<p>none</p>", H.guide_record)["certification"] is None
    assert one(spark, GUIDE, H.guide_sections) == {"violence_gore": ["A fight & a féte", "More"], "profanity": ["None"]}


def test_entities_do_not_decode_twice(spark):
    assert one(spark, "&amp;lt; &#60; &unknown; &#xD800; a&#b", H.decode_entities) == "&lt; < &unknown; &#xD800; a&#b"


def test_table_with_line_breaks_and_broken_bytes(spark, tmp_path):
    path = tmp_path / "records.csv"
    path.write_bytes(b'TITLE,RATING,REASON,YEAR\n"A ""b"",\nc",R,caf\xff\xc3\xa9,1999\nD,PG,,2001\n')
    rows = readers.read_table(spark, str(path), readers.RATING_RECORDS_SCHEMA).orderBy("YEAR").collect()
    assert [tuple(r) for r in rows] == [('A "b",\nc', "R", "caf\u00e9", 1999), ("D", "PG", None, 2001)]


def test_elements_inside_elements(spark):
    box = '<div class="display"><p>one</p><div>two<div>three</div></div><p>four</p></div><div>no</div>'
    assert one(spark, box, lambda c: H.element(c, "div", 'class="display"')) == "<p>one</p><div>two<div>three</div></div><p>four</p>"
    assert one(spark, "<p>none</p>", lambda c: H.element(c, "div")) == ""
    assert one(spark, "<div>open", lambda c: H.element(c, "div")) == "open"
    cells = 'beside<span><b>A</b> film<br>x</span> <div><i>PG</i></div><span></span></div><span>after</span>'
    assert one(spark, cells, H.child_texts) == ["A filmx", "PG", ""]


def test_last_entry_wins(spark):
    entries = "array(named_struct('key', 'b', 'value', 1), named_struct('key', 'a', 'value', 2), named_struct('key', 'b', 'value', 3))"
    assert spark.range(1).select(H.last_wins(F.expr(entries)).alias("out")).first()["out"] == {"a": 2, "b": 3}


def test_xml_files_are_bounded():
    """A file is read in one task. Before, all documents of a partition made one file, however many they were."""
    docs = [f"<document>{'x' * 80}{i}</document>" for i in range(50)]
    batches = [pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["value"]) for rows in ([*docs[:30], None, "<document><s>"], [], docs[30:])]
    files = [value for batch in _in_elements(iter(batches), 1000) for value in batch.column(0).to_pylist()]
    lines = [text.split("\n") for text in files]
    assert all(len(text) < 1300 for text in files) and len(files) >= 6
    assert all(x[0] == "<all>" and x[-1] == "</all>" for x in lines)
    assert [doc for x in lines for doc in x[1:-1]] == docs


ODD_WORDS = {
    "<w/>": [""], "<w> </w><w>y</w>": ["", "y"], "<w>a&amp;b&lt;c</w>": ["a&b<c"], "<w>a<b>c</b>d</w>": ["d"], "<w><b>c</b></w>": [""],
    "<w>a<!-- x -->b</w>": ["b"], "<w><![CDATA[x]]></w>": ["x"], "<w id='>'>a</w><w txt='q'>b</w>": ["a", "b"], "": [], "text": [],
}


def test_words_are_parsed_as_strings_with_the_results_of_elements(spark):
    rows = spark.createDataFrame([(i, f"<document><s id='1'>{words}</s></document>") for i, words in enumerate(ODD_WORDS)], "i INT, xml STRING")
    as_elements = F.from_xml("xml", X.SUBTITLE_SCHEMA, X.XML_OPTIONS)
    docs = rows.select("i", X.parse_subtitle(F.col("xml")).alias("new"), as_elements.alias("old")).orderBy("i")
    assert docs.schema["new"].dataType["s"].dataType.elementType["w"].dataType.simpleString() == "array<string>"
    got = docs.select(X.sentence_rows(F.col("new"))[0]["words"].alias("new"), X.sentence_rows(F.col("old"), "txt")[0]["words"].alias("old"))
    assert [(r["new"], r["old"]) for r in got.collect()] == [(words, words) for words in ODD_WORDS.values()]


def test_sentence_elements_number_words(spark):
    text = spark.createDataFrame([(" a  b<c \n\n \nd",), (None,)], "text STRING")
    got, null = (r[0] for r in text.select(X.sentence_elements(F.col("text"))).collect())
    time = lambda i: f'<s id="{i + 1}"><time id="T{i + 1}S" value="00:00:{2 * i:02d},000"/>'
    assert got == f'{time(0)}<w id="1.1">a</w><w id="1.2">b&lt;c</w></s>{time(1)}</s>{time(2)}</s>{time(3)}<w id="4.1">d</w></s>'
    assert null is None
