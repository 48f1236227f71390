import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scalars as S
from quillspark.functions import text as T


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("v")).first()["v"]


def test_sentences(spark):
    t = "一句。二句！ 三；\r\n\n four. five\x0b  \n   \n"
    assert one(spark, T.sentences(F.lit(t))) == ["一句", "二句", "三", "four. five"]
    assert one(spark, T.sentences(F.lit(" \n\t"))) == []
    assert one(spark, T.sentences(F.lit("a. b。c"), ascii_stop=True)) == ["a.", "b", "c"]


def test_html(spark):
    assert one(spark, T.tag_tokens(F.lit("a<b>c</b> <br/><unclosed"))) == ["a", "<b>", "c", "</b>", "<br/>", "<unclosed"]
    assert one(spark, T.tag_tokens(F.lit("plain"))) == ["plain"]
    assert one(spark, T.collapse_blank_lines(F.lit(" a \n \n\n b\n"))) == "a\nb"


def test_tokens(spark):
    t = "漢字 two words, 12!"
    assert one(spark, T.estimated_tokens(F.lit(t))) == int(2 * 1.5 + 2 * 1.3 + 4 * 1.2)
    assert one(spark, T.word_tokens(F.lit("two words, 12!"))) == 5


def test_cleaning(spark):
    assert one(spark, T.clean_input(F.lit("  a\x00b \r\n c  "), 4)) == "ab c"
    assert one(spark, T.clean_output(F.lit(" [INST] x  <|im_end|> y "))) == "x y"
    assert one(spark, T.clean_description(F.lit("<image> A dog  runs"))) == "A dog runs."
    assert one(spark, T.clean_description(F.lit("Really?"))) == "Really?"
    assert one(spark, T.clean_description(F.lit("  "))) == ""
    f = [{"type": "remove_redundant"}, {"type": "capitalize_first"}, {"type": "length_limit", "max_length": 5}]
    assert one(spark, T.description_filters(F.lit("The image shows a dog running"), f)) == "A dog..."
    g = [{"type": "remove_prefix", "value": "A:"}, {"type": "remove_suffix", "value": "!"}, {"type": "replace", "old": "x", "new": "yy"}]
    assert one(spark, T.output_filters(F.lit("A: ax !"), g)) == "ayy"
    assert one(spark, T.apply_template(F.lit("q"), "Say {input}.")) == "Say q."
    assert one(spark, T.apply_template(F.lit("q"), "Say {other}.")) == "q"
    assert one(spark, T.to_traditional(F.lit("国"), {"国": "國"})) == "國"


def test_tables(spark):
    header, rows = F.array(F.lit("a"), F.lit("longer")), F.array(F.array(F.lit("1"), F.lit(None)), F.array(F.lit(" "), F.lit("x")))
    assert one(spark, T.markdown_table(header, rows)) == "| a | longer |\n| --- | ------ |\n| 1 | - |\n| - | x |"
    grid = F.array(F.array(F.lit("h|1"), F.lit(" h  2 ")), F.array(F.lit("a"), F.lit("b")))
    assert one(spark, T.grid_markdown(grid)) == "| h\\|1 | h 2 |\n| --- | --- |\n| a | b |"
    cells = F.array(*[F.struct(F.lit(r).alias("row"), F.lit(c).alias("col"), F.lit(t).alias("text")) for r, c, t in [(0, 0, "x"), (0, 0, "y"), (1, 1, "z"), (5, 0, "out")]])
    assert one(spark, T.cells_grid(cells, F.lit(2), F.lit(2))) == [["y", ""], ["", "z"]]
    text = "a\n| 1 | 2 |\n| 3 | 4 |\nb\n| 5 |\n"
    assert one(spark, T.markdown_tables(F.lit(text))) == ["| 1 | 2 |\n| 3 | 4 |\n", "| 5 |\n"]
    none = F.array().cast("array<array<string>>")
    got = one(spark, T.table_text(none, F.slice(cells, 1, 0), F.lit(0), F.lit(0), F.lit(text), F.lit(1)))
    assert got == "<TABLE>\n| 5 |\n\n</TABLE>"


def test_names(spark):
    for name, want in (("llava-7b-v1", 7_000_000_000), ("x-1.5B", 1_500_000_000), ("v2-270m", 270_000_000), ("5m", None), ("a2b2000b", 2_000_000_000), ("none", None), ("1,300m", 1_300_000_000)):
        assert one(spark, T.params_from_name(F.lit(name))) == want, name
    for size, want in (("7B", 7.0), ("500 M", 0.5), ("1500K", 0.0015), ("13", 13.0), ("?", 1.0), ("1.2.3B", 1.0)):
        assert one(spark, T.params_in_billions(F.lit(size))) == pytest.approx(want), size
    assert one(spark, T.model_family(F.lit("My-TrOCR-Llama"))) == "trocr"
    assert one(spark, T.chunk_name(F.lit("a.tar.gz"), F.lit(3))) == "a.tar_chunk_3"
    assert one(spark, T.image_text(F.lit(" "))) == ""
    items = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(y).alias("center_y"), F.lit(s).alias("score")) for t, y, s in [("a", 1.0, 0.9), ("b", 50.0, 0.7), ("c", 90.0, 0.69), ("d", 99.0, 0.8)]])
    assert one(spark, T.region_text(items, F.lit(100.0))) == "upper: a | middle: b | lower: d"


def test_paths(spark):
    for p, want in (("/a//b\\c/", "a/b/c"), ("a/../b", None), ("..a", "..a")):
        assert one(spark, S.sanitise_path(F.lit(p))) == want
    for n, want in (("x%2Fy+z é.txt", "y_z_é.txt"), ("..", None), ("a/b.c", "b.c"), ("", None)):
        assert one(spark, S.sanitise_name(F.lit(n))) == want, n


def test_estimates(spark):
    assert one(spark, S.bytes_per_param(F.lit("q4_k_m"), F.lit("fp32"))) == 0.5
    assert one(spark, S.bytes_per_param(F.lit("odd"), F.lit("INT8"))) == 1.0
    p = 7_000_000_000
    e = one(spark, S.resource_estimate(F.lit(p), F.lit("text-generation-hf"), F.lit(2.0)))
    hidden = max(64, int(p**0.5 * 0.7))
    act = int(2560 * hidden * 2) + int(2048 * hidden * 2 * 2)
    assert e["total_gb"] == pytest.approx((p * 2 + act + 500 * 1024**2) / 1024**3)
    assert e["latency_s"] == pytest.approx(2.0 * p * 2560 / 40e12 * 5)
    for n, want in ((0, 0), (1, 1), (5, 1), (6, 2), (100, 2), (10_000, 6)):
        layers, items = (0, 0) if n <= 0 else (1, -(-n // 5))
        while items > 1:
            items, layers = -(-items // 4), layers + 1
            if items * 512 <= 4800:
                break
        assert one(spark, S.summary_layers(F.lit(n))) == layers
    tags = one(spark, S.estimate_tags({"a": (F.lit(1.5), "double"), "b": (F.lit(None).cast("string"), "text"), "c": (F.array(F.lit("x"), F.lit("y")), "list")}))
    assert tags == {"est_a": "1.5000", "est_c": "x,y"}
    assert one(spark, S.tile_grid(F.lit(1344), F.lit(448)))["cols"] == 3
    assert one(spark, S.dataset_type(F.array(F.lit("text"), F.lit("img")))) == "image"
    assert one(spark, S.content_to_embed(F.lit("summary"), F.lit(""), F.lit("t"))) == "t"
    assert one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert [r["label"] for r in one(spark, S.top_labels(F.array(F.lit("b"), F.lit("a"), F.lit("c")), F.array(F.lit(0.5), F.lit(0.5), F.lit(0.9)), 2))] == ["c", "a"]
    flat = F.array_repeat(F.lit(1), 256)
    assert one(spark, S.frame_is_good(F.lit(6.0), flat)) and not one(spark, S.frame_is_good(F.lit(5.0), flat))


def test_keys_and_dates(spark):
    a, b = (one(spark, S.cache_key("s", filter=F.lit(x), limit=F.lit(5))) for x in ("p", "q"))
    assert a != b and re.fullmatch("[0-9a-f]{64}", a)
    assert one(spark, S.decode_base64(F.lit("data:image/png;base64,YWI="))) == b"ab"
    assert one(spark, S.parse_iso(F.lit("nonsense"))) is None
    assert one(spark, S.epoch_ms_text(F.lit(0).cast("long"))) == "1970-01-01 00:00:00"
    assert one(spark, S.dynamic_ttl(F.lit(3600), F.lit(3))) == 3708
