"""Entity resolution: listings to products, by identifier, then by name within a brand.

The pair comparison is a blocked join of different names: where both sizes are known it is an
equi-join on brand and size, elsewhere on brand. Names are scored once for each distinct pair of
keys; offers and products are joined only where their names are similar.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import numbers as N
from ..functions import rules
from ..functions import text as T


@dataclass(frozen=True)
class Thresholds:
    auto: float = rules.AUTO_LINK
    review: float = rules.REVIEW
    margin: float = rules.RUNNER_UP_MARGIN
    create: bool = True


def _matches(a: str, b: str) -> int:
    """Length of the longest common subsequence; a row's bits are the places where it grows."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def token_set_ratio(a: str, b: str) -> float:
    """0-100: the best agreement among shared words, and shared words with either side's own."""
    one, two = set(a.split()), set(b.split())
    shared, own, other = (" ".join(sorted(x)) for x in (one & two, one - two, two - one))
    if shared and (not own or not other):
        return 100.0
    if not one or not two:
        return 0.0
    left, right = (f"{shared} {x}".strip() for x in (own, other))
    whole = len(left) + len(right)
    apart = len(own) + len(other) - 2 * _matches(own, other)
    best = 100 - 100 * apart / whole
    if shared:
        for x in (left, right):
            best = max(best, 100 - 100 * (len(x) - len(shared)) / (len(x) + len(shared)))
    return best


@F.pandas_udf(DoubleType())
def name_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b)])


def _once(rows: DataFrame, by: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`rows` with the columns that `work` adds to different values of `by`, which it sees once each, spread over all cores."""
    spark = rows.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    known = work(rows.select(*by).distinct().repartition(n)).withColumnsRenamed({c: f"_once_{c}" for c in by})
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_once_{c}")) for c in by))
    return rows.join(known, same).drop(*(f"_once_{c}" for c in by))


def offer_keys(offers: DataFrame, *more: str) -> DataFrame:
    """offers: offer_id, title, brand_name, ean, size_value, size_unit -> what matching compares, and `more` of their columns."""
    by = ["title", "brand_name", "size_value", "size_unit"]
    keys = [T.brand_key(T.canonical_brand(F.col("brand_name"))).alias("brand_key"), T.name_tokens(F.col("title"), F.col("brand_name")).alias("tokens"), N.offer_size(F.col("title"), F.col("size_value"), F.col("size_unit")).alias("_size")]
    found = ["brand_key", "tokens", F.array_join("tokens", " ").alias("name_key"), F.col("_size.value").alias("size"), F.col("_size.unit").alias("unit"), F.col("_size.count").alias("packs")]
    keyed = _once(offers.select(*dict.fromkeys(["offer_id", "ean", *by, *more])), by, lambda d: d.select(*by, *keys).select(*by, *found))
    return keyed.select("offer_id", "brand_key", "tokens", "name_key", "ean", "size", "unit", "packs", *more)


def product_keys(products: DataFrame) -> DataFrame:
    """products: product_id, name, brand, ean, size_value, size_unit."""
    base, tokens = N.base_size(F.col("size_value"), F.col("size_unit")), T.name_tokens(F.col("name"), F.col("brand"))
    keyed = _once(products, ["name", "brand"], lambda d: d.select("name", "brand", T.brand_key(F.col("brand")).alias("brand_key"), tokens.alias("p_tokens")).withColumn("p_name_key", F.array_join("p_tokens", " ")))
    return keyed.select("product_id", "brand_key", "p_tokens", "p_name_key", F.col("ean").alias("p_ean"), base["value"].alias("p_size"), base["unit"].alias("p_unit"))


def _only(a: str, b: str) -> Column:
    return F.filter(F.array_distinct(F.array_except(a, b)), T.distinctive)


def _bin(size: Column, unit: Column) -> Column:
    return F.concat(size.cast("decimal(18,6)").cast("string"), F.lit(" "), unit)


def _sides(offers: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the bins of sizes they can meet in: an offer's sizes (one item's, a pack's total) and "", products' size or "" if unknown."""
    size, unit = F.col("size"), F.col("unit")
    total = F.when(F.col("packs") > 1, _bin(size.cast("decimal(18,6)") * F.col("packs"), unit))
    bins = F.when(size.isNotNull(), F.array_distinct(F.array_compact(F.array(F.lit(""), _bin(size, unit), total))))
    return offers.where("brand_key is not null and size(tokens) > 0").withColumn("bins", bins), products.where("size(p_tokens) > 0").withColumn("bin", F.when(F.col("p_size").isNull(), "").otherwise(_bin(F.col("p_size"), F.col("p_unit"))))


def _similar(own: DataFrame, theirs: DataFrame, review: float) -> DataFrame:
    """(brand_key, name_key, p_name_key, exact_score, markers): pairs of names that meet in a bin, score `review` or more and don't contradict each other."""
    names = own.select("brand_key", "name_key", F.explode("bins").alias("bin")).distinct().join(theirs.select("brand_key", "p_name_key", "bin").distinct(), ["brand_key", "bin"]).drop("bin")
    open_ = own.where("bins is null").select("brand_key", "name_key").distinct().join(theirs.select("brand_key", "p_name_key").distinct(), "brand_key")
    met = stored(names.unionByName(open_).distinct())
    words = met.select("name_key", "p_name_key").distinct().withColumns({"_a": F.split("name_key", " "), "_b": F.split("p_name_key", " ")}).withColumns({"_a": _only("_a", "_b"), "_b": _only("_b", "_a")})
    numeric = lambda c: F.exists(c, lambda x: x.rlike("^[0-9]+$"))
    scores = words.where(~(numeric(F.col("_a")) & numeric(F.col("_b")))).withColumn("exact_score", name_score("name_key", "p_name_key")).where(F.col("exact_score") >= review)
    markers = F.array_sort(F.array_union("_a", "_b"))
    said = F.when(F.size(markers) > 0, F.concat(F.lit("variant markers differ: "), F.array_join(markers, ", ")))
    return stored(met.join(scores.select("name_key", "p_name_key", "exact_score", said.alias("markers")), ["name_key", "p_name_key"]))


def _pairs(own: DataFrame, theirs: DataFrame, similar: DataFrame) -> DataFrame:
    """Rows of both sides whose names are similar and that can meet; nothing else is paired."""
    named = own.join(similar, ["brand_key", "name_key"])
    sized = named.where("bins is not null").withColumn("bin", F.explode("bins")).join(theirs, ["brand_key", "p_name_key", "bin"])
    return sized.unionByName(named.where("bins is null").join(theirs, ["brand_key", "p_name_key"]), allowMissingColumns=True)


def _said(*key: str) -> list[str | Column]:
    unknown = F.when(F.col("size").isNull() | F.col("p_size").isNull(), "size unknown")
    doubts = F.array_compact(F.array("markers", unknown, F.when(F.col("packs") > 1, F.concat(F.lit("multipack of "), F.col("packs")))))
    return [*key, "product_id", F.round("exact_score", 2).alias("score"), doubts.alias("doubts"), "packs", "exact_score"]


def candidates(offers: DataFrame, products: DataFrame, rejected: DataFrame | None = None, review: float = rules.REVIEW) -> DataFrame:
    """(offer_id, product_id, score, doubts, packs) of same-brand pairs from `review` on that nothing contradicts.

    Names are compared first, then rows of similar names are joined: the work is that of the
    different names and of the result. Both sides are read several times, so they had better be stored.
    """
    own, theirs = _sides(offers, products)
    pairs = _pairs(own, theirs.drop("ean"), _similar(own, theirs, review)).where("ean is null or p_ean is null or ean = p_ean")
    if rejected is not None:
        pairs = pairs.join(rejected.select("offer_id", "product_id"), ["offer_id", "product_id"], "left_anti")
    return pairs.select(*_said("offer_id"))


def leading(offers: DataFrame, products: DataFrame, rejected: DataFrame | None = None, review: float = rules.REVIEW, most: int = rules.REVIEW_ROWS) -> DataFrame:
    """The candidates in the first `most` places of each offer, exactly those of `ranked`, without making the others.

    Offers of one name, size and pack, all with or all without identifier, have the same candidates but for equal
    identifiers; products of one name and size score alike, so only the lowest ids of each can be among the first.
    Offers with a rejected product go through all their candidates.
    """
    if rejected is not None:
        some = rejected.select("offer_id").distinct()
        every = candidates(offers.join(some, "offer_id", "left_semi"), products, rejected, review)
        return _first(every, most, "offer_id").unionByName(leading(offers.join(some, "offer_id", "left_anti"), products, None, review, most))
    own, theirs = _sides(offers, products)
    similar = _similar(own, theirs, review)
    kind = ["brand_key", "name_key", "size", "unit", "packs", "coded"]
    own = own.withColumn("coded", F.col("ean").isNotNull())
    own = own.withColumn("kind", F.to_json(F.struct(*kind), {"ignoreNullFields": "false"}))
    low = Window.partitionBy("brand_key", "p_name_key", "bin", F.col("p_ean").isNull()).orderBy("product_id")
    short = theirs.withColumn("_n", F.row_number().over(low)).where(F.col("_n") <= most).drop("_n")
    kinds = own.select("kind", *kind, "bins").distinct()
    found = stored(_first(_pairs(kinds, short, similar).where("not coded or p_ean is null").select(*_said("kind")), most, "kind"))
    apart = own.select("offer_id", "kind", "coded").join(found, "kind").drop("kind")
    pairs = _pairs(own.where("coded").join(theirs.select(F.col("p_ean").alias("ean")).distinct(), "ean", "left_semi"), theirs, similar).where("ean = p_ean")
    coded = apart.where("coded").drop("coded").unionByName(pairs.select(*_said("offer_id")))
    return apart.where("not coded").drop("coded").unionByName(_first(coded, most, "offer_id"))


def _first(found: DataFrame, most: int, key: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("exact_score"), "product_id"))
    return found.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def ranked(found: DataFrame) -> DataFrame:
    """Candidates with their place and the best one's lead on the next."""
    order = Window.partitionBy("offer_id").orderBy(F.desc("exact_score"), "product_id")
    return found.withColumns({"place": F.row_number().over(order), "lead": F.col("exact_score") - F.lead("exact_score").over(order)})


def by_ean(offers: DataFrame, products: DataFrame) -> DataFrame:
    """(offer_id, product_id) of equal identifiers."""
    return offers.where("ean is not null").join(products.where("p_ean is not null").select("product_id", F.col("p_ean").alias("ean")), "ean").select("offer_id", "product_id")


def decisions(offers: DataFrame, linked: DataFrame, found: DataFrame, ean_links: DataFrame, pending: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """(offer_id, method, product_id, note) of each offer, in this order: linked, identifier, waiting, name, review, new product, unmatched.

    offers: keys of all offers; found: `candidates` or the `leading` ones; linked and ean_links: offer_id, product_id; pending: offer_id.
    """
    best = ranked(found).where("place = 1").select("offer_id", F.col("product_id").alias("best"), "exact_score", F.size("doubts").alias("n_doubts"), "lead")
    rows = (
        offers.select("offer_id", "brand_key", "packs").join(linked.select("offer_id", F.col("product_id").alias("have")), "offer_id", "left")
        .join(ean_links.select("offer_id", F.col("product_id").alias("same")), "offer_id", "left").join(pending.select("offer_id", F.lit(True).alias("waits")).distinct(), "offer_id", "left").join(best, "offer_id", "left")
    )
    sure = (F.col("exact_score") >= limits.auto) & (F.col("n_doubts") == 0) & (F.col("lead").isNull() | (F.col("lead") >= limits.margin))
    note = F.lit("no candidate") if not limits.create else F.when(F.coalesce(F.col("brand_key"), F.lit("")) == "", "brand unknown").when(F.col("packs") > 1, F.concat(F.lit("multipack of "), F.col("packs")))
    method = (
        F.when(F.col("have").isNotNull(), "already_linked").when(F.col("same").isNotNull(), "ean").when(F.col("waits"), "awaiting_review").when(sure, "fuzzy").when(F.col("best").isNotNull(), "review")
        .when(note.isNotNull(), "unmatched").otherwise("new_product")
    )
    out = rows.withColumn("method", method)
    product = F.when(F.col("method") == "already_linked", F.col("have")).when(F.col("method") == "ean", F.col("same")).when(F.col("method") == "fuzzy", F.col("best"))
    return out.select("offer_id", "method", product.alias("product_id"), F.when(F.col("method") == "unmatched", note).alias("note"))


def review_rows(found: DataFrame, decided: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """The best candidates of offers that go to review, with the reason; if the best would have done alone, all say so."""
    places = ranked(found).join(decided.where("method = 'review'").select("offer_id"), "offer_id", "left_semi")
    order = Window.partitionBy("offer_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sure = F.first((F.col("exact_score") >= limits.auto) & (F.size("doubts") == 0)).over(order)
    reasons = F.when(sure, F.concat("doubts", F.array(F.lit("several close matches")))).otherwise(F.col("doubts"))
    reason = F.substring(F.coalesce(F.nullif(F.array_join(reasons, "; "), F.lit("")), F.lit("close score")), 1, rules.REASON_LENGTH)
    return places.withColumn("reason", reason).where(F.col("place") <= rules.REVIEW_ROWS).select("offer_id", "product_id", "score", "reason", F.lit("pending").alias("status")).orderBy("offer_id", F.desc("score"), "product_id")


def merged_reviews(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Review rows after a run: pending ones are updated, decided ones stay, others are added."""
    key = ["offer_id", "product_id"]
    decided = existing.where("status <> 'pending'")
    fresh = new.join(decided.select(key), key, "left_anti")
    return decided.unionByName(existing.where("status = 'pending'").join(fresh.select(key), key, "left_anti")).unionByName(fresh)


def new_products(offers: DataFrame, decided: DataFrame, first_id: Column) -> DataFrame:
    """One product for each offer that starts one: brand, name, size and category from the listing. offers: with title and brand_name."""
    rows = offers.join(decided.where("method = 'new_product'").select("offer_id"), "offer_id", "left_semi")
    sized = N.offer_size(F.col("title"), F.col("size_value"), F.col("size_unit"))
    name = T.display_name(F.col("title"), F.col("brand_name"))
    return rows.select(
        (first_id + F.row_number().over(Window.orderBy("offer_id"))).alias("product_id"), "offer_id", T.canonical_brand(F.col("brand_name")).alias("brand"), name.alias("name"), T.fold(name).alias("normalized_name"),
        sized["value"].alias("size_value"), sized["unit"].alias("size_unit"), T.categorize(F.col("title")).alias("category"), "ean",
    )


def enriched(products: DataFrame, links: DataFrame) -> DataFrame:
    """Products with an identifier and picture from their listings where they have none; an identifier goes to one product only.

    products: product_id, ean, image_url; links: offer_id, product_id, ean, image_url.
    """
    taken = products.where("ean is not null").select("ean")
    offered = links.where("ean is not null").join(taken, "ean", "left_anti")
    first = offered.groupBy("ean").agg(F.min_by("product_id", "offer_id").alias("product_id"), F.min("offer_id").alias("offer_id"))
    eans = first.groupBy("product_id").agg(F.min_by("ean", "offer_id").alias("_ean"))
    images = links.where("image_url is not null").groupBy("product_id").agg(F.min_by("image_url", "offer_id").alias("_image"))
    out = products.join(eans, "product_id", "left").join(images, "product_id", "left")
    return out.withColumns({"ean": F.coalesce("ean", "_ean"), "image_url": F.coalesce("image_url", "_image")}).drop("_ean", "_image")


FOLDED = "offer_id long, method string, product_id long, created_by long, note string"


def sequential(offers: DataFrame, products: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Offers matched one after another by id, so that a product an offer starts is there for the next.

    Groups that can't affect each other (brands, joined where an identifier crosses them) are
    folded apart, each by itself in order. offers: offer_keys with `own_tokens` (of the name a new
    product would get); products: product_keys. created_by: the offer that started the product, whose
    id is then null. A brand is one group, folded in one task: its different names are compared
    with each other, its offers only looked up by name and size.
    """
    group = _groups(offers, products)
    keyed = offers.join(group, "brand_key", "left").withColumn("grp", F.coalesce("grp", F.concat(F.lit("offer "), F.col("offer_id"))))
    theirs = products.join(group, "brand_key")
    return keyed.groupBy("grp").cogroup(theirs.groupBy("grp")).applyInPandas(lambda o, p: _fold(o, p, limits), FOLDED)


def _groups(offers: DataFrame, products: DataFrame) -> DataFrame:
    """(brand_key, grp): brands linked by identifiers have the lowest of their keys."""
    eans = offers.select("brand_key", "ean").unionByName(products.select("brand_key", F.col("p_ean").alias("ean"))).where("brand_key is not null").distinct()
    label = eans.select("brand_key", F.col("brand_key").alias("grp")).distinct()
    shared = eans.where("ean is not null")
    while True:
        low = shared.join(label, "brand_key").groupBy("ean").agg(F.min("grp").alias("low"))
        best = shared.join(low, "ean").groupBy("brand_key").agg(F.min("low").alias("low"))
        new = label.join(best, "brand_key", "left").select("brand_key", F.least("grp", F.coalesce("low", "grp")).alias("grp"))
        new = stored(new)
        if new.exceptAll(label).isEmpty():
            return new
        label = new


def stored(df: DataFrame) -> DataFrame:
    """`df` written to a shared folder and read again, for what is costly to make and read more than once."""
    df.write.mode("overwrite").parquet(path := _scratch(df.sparkSession))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _scratch(spark) -> str:
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isEmpty() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if known.isEmpty():  # all runs in one process
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pricetide-"))
            known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get()
    return f"{root}/groups-{uuid.uuid4().hex}"


class _Shelf:
    """Products in order, found by identifier and by brand, name and size, so that an offer looks only at names like its own."""

    def __init__(self, review: float):
        self.rows: list[dict] = []
        self.review = review
        self.by_ean: dict[str, int] = {}  # the first place of each identifier
        self.names: dict[str | None, list[tuple[str, dict]]] = {}  # by brand: names in the order they came, with their bins
        self.known: dict[tuple, dict] = {}
        self.scored: dict[tuple, tuple[int, list]] = {}

    def put(self, product: dict) -> None:
        at = len(self.rows)
        self.rows.append(product)
        if product["ean"]:
            self.by_ean.setdefault(product["ean"], at)
        if not product["tokens"]:
            return
        name = " ".join(product["tokens"])
        if (bins := self.known.get((product["brand"], name))) is None:
            bins = self.known[product["brand"], name] = {}
            self.names.setdefault(product["brand"], []).append((name, bins))
        for key in _bins(product):
            every, free = bins.setdefault(key, ([], OrderedDict()))
            every.append(at)
            if not product["ean"]:
                free[at] = None

    def identify(self, at: int, ean: str) -> None:
        """Gives a product an identifier that no other has."""
        product = self.rows[at]
        product["ean"] = ean
        self.by_ean[ean] = at
        if product["tokens"]:
            bins = self.known[product["brand"], " ".join(product["tokens"])]
            for key in _bins(product):
                bins[key][1].pop(at, None)

    def like(self, brand: str | None, tokens: list[str]) -> list[tuple[float, bool, dict]]:
        """(score, whether variant markers differ, bins) of the brand's names from `review` on; each pair of names is scored once."""
        names, name = self.names.get(brand, []), " ".join(tokens)
        seen, found = self.scored.get((brand, name), (0, []))
        mine = set(tokens)
        for other, bins in names[seen:]:
            theirs = set(other.split(" "))
            a, b = _special(mine - theirs), _special(theirs - mine)
            if any(t.isdigit() for t in a) and any(t.isdigit() for t in b):
                continue
            if (score := token_set_ratio(name, other)) >= self.review:
                found.append((score, bool(a or b), bins))
        self.scored[brand, name] = len(names), found
        return found


ANY, UNSIZED = "any", "unsized"


def _bins(product: dict) -> list:
    return [ANY, UNSIZED if pd.isna(product["size"]) else (product["unit"], product["size"])]


def _special(words: set[str]) -> set[str]:
    return {t for t in words if any(c.isdigit() for c in t) or t == "plus" or len(t) <= 2}


def _fold(offers: pd.DataFrame, products: pd.DataFrame, limits: Thresholds) -> pd.DataFrame:
    shelf = _Shelf(limits.review)
    for p in products.sort_values("product_id").itertuples():
        shelf.put({"id": int(p.product_id), "by": None, "brand": p.brand_key, "tokens": list(p.p_tokens), "ean": p.p_ean, "size": p.p_size, "unit": p.p_unit})
    out = []
    for o in offers.sort_values("offer_id").itertuples():
        method, at, note = _match(o, shelf, limits)
        unknown = o.ean if o.ean and o.ean not in shelf.by_ean else None
        if method == "new_product":
            at = len(shelf.rows)
            shelf.put({"id": None, "by": int(o.offer_id), "brand": o.brand_key, "tokens": list(o.own_tokens), "ean": unknown, "size": o.size, "unit": o.unit})
        elif at is not None and unknown and not shelf.rows[at]["ean"]:
            shelf.identify(at, unknown)
        product = None if at is None else shelf.rows[at]
        out.append((o.offer_id, method, product and product["id"], product and product["by"], note))
    return pd.DataFrame(out, columns=["offer_id", "method", "product_id", "created_by", "note"]).astype({"product_id": "Int64", "created_by": "Int64"})


def _match(o, shelf: _Shelf, limits: Thresholds) -> tuple[str, int | None, str | None]:
    if o.ean and o.ean in shelf.by_ean:
        return "ean", shelf.by_ean[o.ean], None
    unsized, found = pd.isna(o.size), []
    keys = {ANY} if unsized else {UNSIZED, (o.unit, o.size), (o.unit, o.size * o.packs if o.packs > 1 else o.size)}
    for score, marked, bins in shelf.like(o.brand_key, list(o.tokens)) if len(o.tokens) else ():
        for key in keys & bins.keys():
            every, free = bins[key]
            # all of a bin score alike: the first two that no identifier rules out are enough for the best and the lead
            for at in islice(free, 2) if o.ean else every[:2]:
                found.append((-score, at, marked or unsized or key == UNSIZED or o.packs > 1))
    if found:
        found.sort()
        clear = len(found) == 1 or found[1][0] - found[0][0] >= limits.margin
        if -found[0][0] >= limits.auto and not found[0][2] and clear:
            return "fuzzy", found[0][1], None
        return "review", None, None
    if not limits.create:
        return "unmatched", None, "no candidate"
    if not o.brand_key:
        return "unmatched", None, "brand unknown"
    if o.packs > 1:
        return "unmatched", None, f"multipack of {o.packs}"
    return "new_product", None, None


def approved(reviews: DataFrame, decisions_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reviews and links after decisions (offer_id, product_id, verdict, at): the last verdict on a pending pair holds, an approved one rejects its siblings."""
    last = decisions_.groupBy("offer_id", "product_id").agg(F.max_by("verdict", "at").alias("verdict"), F.max("at").alias("at"))
    rows = reviews.join(last, ["offer_id", "product_id"], "left")
    yes = (F.col("status") == "pending") & (F.col("verdict") == "approved")
    first = F.min(F.when(yes, F.struct("at", "product_id"))).over(Window.partitionBy("offer_id"))["product_id"]
    rows = rows.withColumn("_chosen", first)
    status = F.when(F.col("status") != "pending", F.col("status")).when(F.col("_chosen") == F.col("product_id"), "approved").when(F.col("_chosen").isNotNull() | (F.col("verdict") == "rejected"), "rejected").otherwise("pending")
    done = rows.withColumn("status", status)
    return done.select(reviews.columns), done.where("status = 'approved' and _chosen = product_id").select("offer_id", "product_id")


def to_rematch(reviews: DataFrame, links: DataFrame) -> DataFrame:
    """Offers whose candidates have all been rejected and that have no product."""
    per = reviews.groupBy("offer_id").agg(F.bool_and(F.col("status") == "rejected").alias("_none"))
    return per.where("_none").select("offer_id").join(links.select("offer_id"), "offer_id", "left_anti")


def product_category(products: DataFrame, listings: DataFrame) -> DataFrame:
    """(product_id, category): from the name, else from the first listing (by offer_id) that says one."""
    titles = listings.withColumn("_c", T.categorize(F.col("title"))).where(F.col("_c") != rules.OTHER).groupBy("product_id").agg(F.min_by("_c", "offer_id").alias("_said"))
    own = F.nullif(T.categorize(F.col("name")), F.lit(rules.OTHER))
    return products.join(titles, "product_id", "left").select("product_id", F.coalesce(own, "_said", F.lit(rules.OTHER)).alias("category"))


def categorized(products: DataFrame, listings: DataFrame, recompute: bool = False) -> DataFrame:
    """Products with a category where they had none, or all anew."""
    found = product_category(products, listings).withColumnRenamed("category", "_new")
    return products.join(found, "product_id").withColumn("category", F.col("_new") if recompute else F.coalesce("category", "_new")).drop("_new")
