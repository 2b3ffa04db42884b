"""Command line: ``python -m glyphloom.cli correct WORD``, ``text``, ``build-dict``, ``bench``, ``repl``.

Resources are read from ``--data`` (see ``Resources.load``); without it the
demo resources serve.
"""

from __future__ import annotations

import argparse
import sys
import time

from glyphloom.config import Config
from glyphloom.operators.correct import correct_text, correct_words
from glyphloom.session import build_session
from glyphloom.sources.resources import Resources, demo_resources, read_dictionary_json, write_dictionary


def _word(spark, r: Resources, lang: str, word: str, config: Config) -> str:
    got = correct_words(spark.createDataFrame([(lang, word)], "lang string, word string"), r, config.correction).first()
    return got["corrected"] if got and got["corrected"] is not None else word


def _text(spark, r: Resources, lang: str, text: str, config: Config) -> str:
    return correct_text(spark.createDataFrame([(0, text)], "doc_id long, text string"), r, lang, "doc_id", "text", config.correction).first()["corrected_text"]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="glyphloom")
    p.add_argument("-c", "--config", help="JSON settings")
    p.add_argument("-d", "--data", help="folder with dictionaries, stopwords and errors")
    p.add_argument("-l", "--lang", help="language (default: the settings')")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("correct").add_argument("word")
    sub.add_parser("text").add_argument("text")
    sub.add_parser("repl")
    sub.add_parser("bench")
    b = sub.add_parser("build-dict")
    b.add_argument("source")
    b.add_argument("target")
    a = p.parse_args(argv)
    config = Config.load_or_default(a.config) if a.config else Config().validate()
    spark = build_session("glyphloom", "local[*]", {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    if a.command == "build-dict":
        write_dictionary(read_dictionary_json(spark, a.source), a.target)
        return 0
    r = Resources.load(spark, a.data, config.supported_languages) if a.data else demo_resources(spark)
    lang = a.lang or config.user_preferred_language or config.default_language
    if a.command == "correct":
        print(_word(spark, r, lang, a.word, config))
    elif a.command == "text":
        print(_text(spark, r, lang, a.text, config))
    elif a.command == "repl":
        for line in sys.stdin:
            print(_text(spark, r, lang, line.rstrip("\n"), config), flush=True)
    else:
        words = [(lang, f"word{i:06}") for i in range(50_000)]
        began = time.perf_counter()
        n = correct_words(spark.createDataFrame(words, "lang string, word string"), r, config.correction).count()
        print(f"{n} words in {time.perf_counter() - began:.2f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main())
