import base64

from pyspark.sql import functions as F

from threadloom.functions import jsonio
from threadloom.sources import readers, sinks


def test_images_there_and_back(spark, tmp_path):
    blob = bytes(range(256)) * 3
    (tmp_path / "a.png").write_bytes(blob)
    row = readers.read_images(spark, str(tmp_path), "*.png").first()
    assert base64.b64decode(row.image) == blob and "\n" not in row.image
    df = spark.createDataFrame([(1, True, [row.image, "data:image/png;base64," + row.image])], "id int, selfie boolean, images array<string>")
    out = str(tmp_path / "out")
    sinks.write_images(sinks.image_rows(df), out)
    back = spark.read.parquet(out).orderBy("image_no").collect()
    assert [bytes(r.content) for r in back] == [blob, blob] and back[0].file_name == "cutepic.png"


def test_message_readers_fill_what_is_missing(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([(1, "hi")], "msg_id int, content string").write.parquet(path)
    df = readers.read_messages(spark, path)
    assert df.schema == readers.MESSAGE_SCHEMA
    assert df.first().content == "hi" and df.first().attachments is None


def test_text_responses(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.createDataFrame([('{"choices":[{"text":"hi"}]}',)], "value string").write.text(path)
    df = readers.read_responses(spark, path, "text")
    assert df.select(jsonio.parse_choices(F.col("body"))["text"]).first()[0] == "hi"


def test_requests_are_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("two\nlines",)], "p string").select(jsonio.completion_request(F.col("p"), 2).alias("request"))
    sinks.write_requests(df, str(tmp_path / "q"))
    assert spark.read.json(str(tmp_path / "q")).first().prompt == "two\nlines"
