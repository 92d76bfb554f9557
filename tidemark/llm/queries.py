"""One thin query for each operator, over its whole table."""

from __future__ import annotations

from . import chat, media, mixing, neighbours, packing, quality, sharding, simhash, toxicity, url_filter
from .common import table

QUERIES = {
    "op1_media": lambda spark, d: media.op1(table(spark, d, "documents")),
    "op2_url_filter": lambda spark, d: url_filter.op2(table(spark, d, "pages")),
    "op3_mixing": lambda spark, d: mixing.op3(table(spark, d, "documents")),
    "op4_simhash": lambda spark, d: simhash.op4(table(spark, d, "documents")),
    "op5_quality": lambda spark, d: quality.op5(table(spark, d, "documents"), table(spark, d, "labels")),
    "op6_toxicity": lambda spark, d: toxicity.op6(table(spark, d, "documents"), table(spark, d, "labels")),
    "op7_chat": lambda spark, d: chat.op7(table(spark, d, "conversations")),
    "op8_neighbours": lambda spark, d: neighbours.op8(table(spark, d, "embeddings")),
    "op9_packing": lambda spark, d: packing.op9(table(spark, d, "documents")),
    "op10_sharding": lambda spark, d: sharding.op10(table(spark, d, "documents")),
}
ORACLE_SQL = {"op2_url_filter": url_filter.OP2_SQL, "op7_chat": chat.OP7_SQL, "op10_sharding": sharding.OP10_SQL}
