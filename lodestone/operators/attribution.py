"""Contributors: identities, the person each one is, and candidates that carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scalars import collapse, slugify

#: How keys and ids of contributors begin.
BY_EMAIL, BY_NAME, PERSON = "email-sha256:", "name:", "contributor"


def clean_name(name: Column) -> Column:
    """One line of 200 characters at most, else null."""
    line = collapse(name)
    return F.when((line != "") & (F.length(line) <= 200) & ~line.rlike("[\\x00-\\x1F\\x7F]"), line)


def clean_email(email: Column) -> Column:
    low = F.lower(F.trim(email))
    return F.when(low.rlike("^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$") & (F.length(low) <= 320), low)


def with_identity(rows: DataFrame) -> DataFrame:
    """(name, email) cleaned, with `key`; rows without a usable name drop."""
    rows = rows.withColumn("name", clean_name(F.col("name"))).withColumn("email", clean_email(F.col("email"))).filter("name IS NOT NULL")
    key = F.when(F.col("email").isNotNull(), F.concat(F.lit(BY_EMAIL), F.sha2(F.col("email").cast("binary"), 256))).otherwise(F.concat(F.lit(BY_NAME), F.lower("name")))
    return rows.withColumn("key", key)


def person_id(name: Column, key: Column) -> Column:
    slug = slugify(name)
    return F.concat_ws("-", F.lit(PERSON), F.when(slug != "", slug).otherwise(PERSON), F.substring(F.sha2(key.cast("binary"), 256), 1, 10))


def find_people(identities: DataFrame, people: DataFrame) -> DataFrame:
    """Identities (ident, name, email, key) with `person`: the note that is theirs, or null.

    A note of equal key or email is theirs, the smallest id first. Else the one note of equal name, if only one has that
    name and it has no email of its own, or the identity has none. Two people of one name are never told apart by guess.
    """
    p = people.select("id", F.lower(F.trim("name")).alias("p_name"), F.lower("email").alias("p_email"), "attribution_key")
    by_key = p.groupBy(F.col("attribution_key").alias("key")).agg(F.min("id").alias("of_key"))
    by_email = p.filter("p_email IS NOT NULL").groupBy(F.col("p_email").alias("email")).agg(F.min("id").alias("of_email"))
    name_only = F.col("p_email").isNull() & ~F.coalesce(F.startswith("attribution_key", F.lit(BY_EMAIL)), F.lit(False))
    by_name = p.groupBy(F.col("p_name").alias("low")).agg(F.count("*").alias("same"), F.count(F.when(name_only, 1)).alias("bare"), F.min("id").alias("of_name"))
    rows = identities.withColumn("low", F.lower("name")).join(by_key, "key", "left").join(by_email, "email", "left").join(by_name, "low", "left")
    alone = (F.col("same") == 1) & ((F.col("bare") == 1) | F.col("email").isNull())
    # least() passes over nulls
    return rows.select(*identities.columns, F.coalesce(F.least("of_key", "of_email"), F.when(alone, F.col("of_name"))).alias("person"))


def ensure_people(identities: DataFrame, people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ident, person, action) and the new person notes, one an id.

    `upgraded`: a note that only had a name gets the key of an identity with an email.
    """
    found = find_people(identities, people)
    p = people.select(F.col("id").alias("person"), F.col("email").alias("p_email"), F.col("attribution_key").alias("p_key"))
    rows = found.join(p, "person", "left")
    bare = F.col("p_email").isNull() & ~F.coalesce(F.startswith("p_key", F.lit(BY_EMAIL)), F.lit(False))
    action = F.when(F.col("person").isNull(), "inserted").when(F.col("email").isNotNull() & bare, "upgraded").otherwise("existing")
    id_ = F.coalesce("person", person_id(F.col("name"), F.col("key")))
    out = rows.select("ident", id_.alias("person"), action.alias("action"), "name", "key")
    new = out.filter("action = 'inserted'").groupBy(F.col("person").alias("id")).agg(F.min_by("name", "ident").alias("name"), F.min("key").alias("attribution_key"))
    new = new.select("id", F.lit("person").alias("kind"), F.col("name").alias("title"), "name", "attribution_key", F.array(F.lit(PERSON)).alias("tags"))
    return out.select("ident", "person", "action"), new


def attribute(candidates: DataFrame, contributors: DataFrame) -> DataFrame:
    """Candidates (with `ident`, relates) get author, author_ref and the person among what they relate to; without an identity they stay."""
    rows = candidates.join(contributors.select("ident", F.col("name").alias("_name"), F.col("person").alias("_person")), "ident", "left")
    has = F.col("_person").isNotNull()
    return (
        rows.withColumn("author", F.when(has, F.col("_name")).otherwise(F.col("author"))).withColumn("author_ref", F.col("_person"))
        .withColumn("relates", F.when(has, F.array_union(F.coalesce("relates", F.array().cast("array<string>")), F.array("_person"))).otherwise(F.col("relates"))).drop("_name", "_person")
    )


def customer_tag(customer: Column) -> Column:
    """The tag that a manifest's customer gives."""
    return F.when(customer.isNotNull(), F.concat(F.lit("customer:"), slugify(customer)))


def stamp(candidates: DataFrame, source: Column, project: Column, customer: Column) -> DataFrame:
    """A candidate keeps its own source and project, else gets the session's; the customer's tag is added once."""
    tag = customer_tag(customer)
    own = F.coalesce("tags", F.array().cast("array<string>"))
    tags = F.when(tag.isNotNull() & ~F.array_contains(own, tag), F.concat(own, F.array(tag))).otherwise(F.col("tags"))
    return candidates.withColumn("source", F.coalesce(F.nullif("source", F.lit("")), source)).withColumn("project", F.coalesce("project", project)).withColumn("tags", tags)
