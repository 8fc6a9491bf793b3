"""Web search results as a Spark data source; replies come from files, since connectors do the fetching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "title string, url string, snippet string, source string"
# The result list of each provider's JSON reply, its field names and its cap.
PROVIDERS = {
    "google": ("items", "title", "link", "snippet", 10),
    "brave": ("web.results", "title", "url", "description", 20),
    "tavily": ("results", "title", "url", "content", 10),
    "serpapi": ("organic_results", "title", "link", "snippet", 10),
    "searxng": ("results", "title", "url", "content", 20),
    "baidu": ("item_list", "name", "baikeUrl", "abstract", 10),
}


def parse_reply(replies: DataFrame, provider: str, cap: int | None = None) -> DataFrame:
    """query, position, title, url, snippet, source of (query, body) replies of one provider."""
    path, title, url, snippet, most = PROVIDERS[provider]
    item = f"struct<{','.join(f'`{c}`:string' for c in dict.fromkeys((title, url, snippet)))}>"
    schema = f"array<{item}>"
    for name in reversed(path.split(".")):
        schema = f"struct<`{name}`:{schema}>"
    body = F.from_json("body", schema)
    for name in path.split("."):
        body = body[name]
    hits = replies.select("query", F.posexplode(F.slice(body, 1, cap or most)).alias("position", "r"))
    text = lambda c: F.coalesce(F.col("r")[c], F.lit(""))
    return hits.select("query", "position", text(title).alias("title"), text(url).alias("url"), text(snippet).alias("snippet"), F.lit(provider).alias("source"))


def instant_answers(replies: DataFrame, cap: int = 10) -> DataFrame:
    """query, position, title, url, snippet, source of (query, body) instant answers: the abstract, if any, then related topics titled by their first 60 characters."""
    body = F.from_json("body", "Heading string, Abstract string, AbstractURL string, RelatedTopics array<struct<Text:string,FirstURL:string>>")
    one = lambda title, url, snippet: F.struct(title.alias("title"), url.alias("url"), snippet.alias("snippet"))
    text = lambda c: F.coalesce(c, F.lit(""))
    rows = replies.select("query", body.alias("b"))
    head = F.when(text(F.col("b.Abstract")) != "", F.array(one(F.coalesce("b.Heading", "query"), text(F.col("b.AbstractURL")), F.col("b.Abstract"))))
    topics = F.filter("b.RelatedTopics", lambda t: t["Text"].isNotNull() & t["FirstURL"].isNotNull())
    related = F.transform(topics, lambda t: one(F.substring(t["Text"], 1, 60), t["FirstURL"], t["Text"]))
    none = F.array().cast("array<struct<title:string,url:string,snippet:string>>")
    every = F.slice(F.concat(F.coalesce(head, none), F.coalesce(related, none)), 1, cap)
    return rows.select("query", F.posexplode(every).alias("position", "r")).select("query", "position", "r.*", F.lit("duckduckgo").alias("source"))


def heading_links(html: Column, cap: int = 10) -> Column:
    """array of (title, url) of links that open within 200 characters of an <h3>, tags taken out, empty titles left out."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?s)<h3.{0,197}?(<a.*?</a>)'), F.lit(1))
    links = F.transform(blocks, lambda b: F.struct(F.trim(F.regexp_replace(F.regexp_extract(b, r"(?s)<a[^>]*>(.*)</a>", 1), r"<[^>]+>", "")).alias("title"), F.regexp_extract(b, r'href="([^"]*)"', 1).alias("url")))
    return F.slice(F.filter(links, lambda x: x["title"] != ""), 1, cap)


def scraped(html: Column) -> Column:
    """array of (title, url) of result links in an HTML page; redirect addresses are unwrapped."""
    anchors = F.regexp_extract_all(html, F.lit(r'(?is)(<a[^>]*class="[^"]*result__a[^"]*"[^>]*>.*?</a>)'), F.lit(1))
    href = lambda a: F.regexp_extract(a, r'href="([^"]*)"', 1)
    real = lambda u: F.when(u.contains("uddg="), F.try_url_decode(F.regexp_extract(u, r"uddg=([^&]*)", 1))).otherwise(u)
    return F.transform(anchors, lambda a: F.struct(F.trim(F.regexp_replace(a, r"<[^>]+>", "")).alias("title"), real(href(a)).alias("url")))


def saved_replies(spark: SparkSession, path: str) -> DataFrame:
    """query, body of replies kept as JSON lines."""
    return spark.read.schema("query string, body string").json(path)
