import io
import json

import pytest

from inkstone.__main__ import main


def run(spark, *argv):
    out = io.StringIO()
    assert main(list(argv), spark, out) == 0
    return out.getvalue().splitlines()


@pytest.mark.parametrize(
    "argv,expected",
    [
        (("convert", "银行", "不是"), ["yínháng", "bú shì"]),
        (("convert", "北京", "--system", "wade_giles"), ["Pei³-ching¹"]),
        (("convert", "行长大", "--greedy"), ["hángzhǎng dà"]),
        (("slug", "北京市银行"), ["bei3jing1-shi4-yin2hang2"]),
        (("slug", "权利", "--hash", "--fallback", "x"), ["1lpt"]),
        (("script", "玩儿", "--to", "zh-Hant"), ["玩兒"]),
        (("lookup", "银行"), ["yin2 hang2"]),
        (("sandhi", "bùshì", "nǐhǎo", "--third-tone"), ["bú shì", "ní hǎo"]),
        (("number", "12345", "2026"), ["一万两千三百四十五", "两千零二十六"]),
        (("number", "2026", "--style", "digits"), ["二〇二六"]),
        (("number", "95", "--style", "percent"), ["百分之九十五"]),
        (("html", "x"), ["x"]),
    ],
)
def test_answers(spark, argv, expected):
    assert run(spark, *argv) == expected


def test_facts(spark, tmp_path):
    assert json.loads(run(spark, "transcribe", "jiù")[0])["gwoyeu"] == "jiow"
    assert [json.loads(x)["pinyin"] for x in run(spark, "transcribe", "chu¹", "--from", "wade_giles")] == ["zhu1", "chu1", "ju1", "qu1"]
    assert [json.loads(x)["final"] for x in run(spark, "syllable", "jiùshì")] == ["iou", "i"]
    assert [json.loads(x)["state"] for x in run(spark, "explain", "行长大", "--json")] == ["uncertain", "likely", "locked"]
    assert json.loads(run(spark, "info")[0])["characters"] == 21
    (tmp_path / "t").write_text("银行\n好")
    assert run(spark, "convert", "--file", str(tmp_path / "t")) == ["yínháng", "hǎo"]
