"""Registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from . import decontaminate, html, licenses, media, packing, pii, quality, simhash, toxicity, urls
from .common import table


def op1_media(spark, sf_dir):
    return media.text_media(table(spark, sf_dir, "documents"))


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_html(spark, sf_dir):
    return html.main_text(table(spark, sf_dir, "pages"))


def op5_urls(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.every_twentieth(pages))


def op6_pii(spark, sf_dir):
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_media, op2_simhash, op3_toxicity, op4_html, op5_urls, op6_pii, op7_licenses, op8_decontaminate, op9_packing, op10_quality)}
SQL = {"op5_urls": urls.SQL}
