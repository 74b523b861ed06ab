"""Row types of the corpus, its inputs and its logs."""

from pyspark.sql import types as T

# Canonical article columns, in output order.
CANONICAL = ["periodico", "titulo", "fecha", "texto", "url"]

# Columns a stored corpus must have, and those it may have.
REQUIRED = CANONICAL + ["departamento"]
OPTIONAL = ["terminos_encontrado"]

ARTICLE = T.StructType(
    [
        T.StructField("periodico", T.StringType()),
        T.StructField("titulo", T.StringType()),
        T.StructField("fecha", T.TimestampType()),
        T.StructField("texto", T.StringType()),
        T.StructField("url", T.StringType()),
    ]
)

CORPUS = T.StructType(
    ARTICLE.fields
    + [
        T.StructField("terminos_encontrado", T.StringType()),
        T.StructField("departamento", T.StringType()),
    ]
)

LISTING = T.StructType(
    [
        T.StructField("periodico", T.StringType()),
        T.StructField("termino", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("link", T.StringType()),
        T.StructField("fecha", T.TimestampType()),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)

# Payload shapes of the listing APIs.
WP_POSTS = "array<struct<link:string,date:string>>"
QUERYLY = "struct<items:array<map<string,string>>,metadata:struct<total:bigint>>"
RSS_FEED = "struct<channel:struct<item:array<struct<guid:string,pubDate:string>>>>"
