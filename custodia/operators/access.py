"""Row-level security of documents and chunks. Access is denied unless a rule grants it:

1. the principal's e-mail is entitled,
2. the document is a review, and it is the principal's own or the principal may see all reviews,
3. the document's category is public.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import wire
from ..functions.text import preview

ACCESS_COLUMNS = ["entitled_emails", "category", "extracted_employee_id"]


@dataclass(frozen=True)
class Principal:
    email: str
    employee_id: str = ""
    groups: tuple[str, ...] = field(default_factory=tuple)

    def __post_init__(self) -> None:
        if not self.email:
            raise ValueError("a principal needs an e-mail address")


def is_public() -> Column:
    return F.coalesce(F.col("category").isin(wire.PUBLIC_CATEGORIES), F.lit(False))


def is_review() -> Column:
    return F.coalesce(F.col("category") == wire.REVIEW_CATEGORY, F.lit(False))


def visible_to(principal: Principal, compat: bool = False) -> Column:
    """The policy for one principal.

    ``compat`` matches the group as a LIKE pattern over the joined groups, and an absent employee
    id as the empty string; otherwise the group must be equal and the id not empty.
    """
    if compat:
        may_see_all = F.lit(",".join(principal.groups)).like(f"%{wire.REVIEW_GROUP}%")
        own = F.col("extracted_employee_id") == principal.employee_id
    else:
        may_see_all = F.lit(wire.REVIEW_GROUP in principal.groups)
        own = (F.col("extracted_employee_id") == principal.employee_id) & F.lit(principal.employee_id != "")
    entitled = F.coalesce(F.array_contains("entitled_emails", principal.email), F.lit(False))
    return entitled | (is_review() & (F.coalesce(own, F.lit(False)) | may_see_all)) | is_public()


def apply_entitlements(docs: DataFrame, principal: Principal, compat: bool = False) -> DataFrame:
    return docs.filter(visible_to(principal, compat))


def secure_chunks(chunks: DataFrame, docs: DataFrame, principal: Principal, compat: bool = False) -> DataFrame:
    """Chunks whose parent document the principal may see."""
    visible = apply_entitlements(docs, principal, compat).select("document_id")
    return chunks.join(visible, "document_id", "left_semi")


def review_reader() -> Column:
    return F.coalesce(F.array_contains("groups", wire.REVIEW_GROUP), F.lit(False))


def access_grants(docs: DataFrame) -> DataFrame:
    """The policy as a list of grants, one or a few per document: ``grant, grantee, document_id``.

    Public documents and reviews are granted once to a whole class of principals, so the list
    grows with the documents and not with documents times principals.
    """
    own = F.when(is_review() & (F.col("extracted_employee_id") != ""), F.col("extracted_employee_id"))
    personal = F.transform(
        F.coalesce(F.array_distinct("entitled_emails"), F.array().cast("array<string>")),
        lambda email: F.struct(F.lit("email").alias("grant"), email.alias("grantee")),
    )
    entries = F.concat(
        personal,
        _entry(own.isNotNull(), "employee", own),
        _entry(is_review(), "group", F.lit(wire.REVIEW_GROUP)),
        _entry(is_public(), "public", F.lit("*")),
    )
    return docs.select("document_id", F.inline(entries)).select("grant", "grantee", "document_id")


def _entry(condition: Column, grant: str, grantee: Column) -> Column:
    entry = F.struct(F.lit(grant).alias("grant"), grantee.cast("string").alias("grantee"))
    none = F.array().cast("array<struct<grant:string,grantee:string>>")
    return F.when(condition, F.array(entry)).otherwise(none)


def entitlement_pairs(docs: DataFrame, principals: DataFrame) -> DataFrame:
    """``email, document_id`` of every document granted to a principal in person: by e-mail, or as
    the principal's own review. Documents open to a whole class are in ``access_grants`` once."""
    grants = access_grants(docs)
    by_email = principals.select("email", F.col("email").alias("grantee"))
    by_employee = principals.filter("employee_id <> ''").select("email", F.col("employee_id").alias("grantee"))
    mail = grants.filter("grant = 'email'").join(by_email, "grantee").select("email", "document_id")
    own = grants.filter("grant = 'employee'").join(by_employee, "grantee").select("email", "document_id")
    return mail.unionByName(own).distinct()


def visible_counts(docs: DataFrame, principals: DataFrame) -> DataFrame:
    """How many documents each principal may see, counted without listing the pairs.

    Class grants are two totals; personal grants are counted per grantee before the join, leaving
    out documents the class already covers.
    """
    totals = docs.agg(
        F.count_if(is_public()).alias("n_public"),
        F.count_if(is_review()).alias("n_review"),
    )
    flagged = docs.withColumn("public", is_public()).withColumn("review", is_review())
    mail = flagged.filter("NOT public").select(
        F.explode(F.array_distinct("entitled_emails")).alias("email"), "review", "extracted_employee_id"
    )
    per_email = mail.groupBy("email").agg(
        F.count("*").alias("mail_docs"), F.count_if(F.col("review")).alias("mail_reviews")
    )
    own_id = flagged.filter("review AND NOT public AND extracted_employee_id <> ''")
    per_employee = own_id.groupBy(F.col("extracted_employee_id").alias("employee_id")).agg(
        F.count("*").alias("own_reviews")
    )
    both = (
        mail.filter("review AND extracted_employee_id <> ''")
        .groupBy("email", F.col("extracted_employee_id").alias("employee_id"))
        .agg(F.count("*").alias("both_reviews"))
    )
    people = (
        principals.withColumn("reader", review_reader())
        .join(per_email, "email", "left")
        .join(per_employee, "employee_id", "left")
        .join(both, ["email", "employee_id"], "left")
        .withColumn("n_public", totals.select("n_public").scalar())
        .withColumn("n_review", totals.select("n_review").scalar())
    )
    n = lambda name: F.coalesce(F.col(name), F.lit(0))
    personal = F.when(F.col("reader"), n("mail_docs") - n("mail_reviews") + F.col("n_review")).otherwise(
        n("mail_docs") + n("own_reviews") - n("both_reviews")
    )
    return people.select("email", (F.col("n_public") + personal).cast("bigint").alias("n_visible"))


def resolve_principals(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests with the profile of their user; unknown users are left out."""
    return requests.join(users, "email")


def unknown_requests(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests of users nobody knows, to be rejected."""
    return requests.join(users.select("email"), "email", "left_anti")


def document_totals(docs: DataFrame, chunks: DataFrame, principal: Principal | None = None) -> DataFrame:
    """Number of documents and chunks, all or those the principal may see."""
    if principal is not None:
        chunks = secure_chunks(chunks, docs, principal)
        docs = apply_entitlements(docs, principal)
    n_chunks = chunks.agg(F.count("*").alias("chunks")).scalar()
    return docs.agg(F.count("*").alias("documents")).withColumn("chunks", n_chunks)


def list_documents(docs: DataFrame, principal: Principal, limit: int | None = None) -> DataFrame:
    """Visible documents, newest first; ties by id. ``limit`` gives the short list with previews.

    ``document_id`` is the key of the documents, so the rows are distinct without a shuffle.
    """
    shown = ["document_id", "title", "category", "extracted_employee_id", "created_at"]
    visible = apply_entitlements(docs, principal)
    order = [F.col("created_at").desc(), F.col("document_id").asc()]
    if limit is None:
        return visible.select(*shown).orderBy(*order)
    return visible.select(*shown, preview(F.col("content")).alias("content_preview")).orderBy(*order).limit(limit)


def category_counts(docs: DataFrame) -> DataFrame:
    """Documents per category, most frequent first."""
    counted = docs.groupBy("category").agg(F.count("*").alias("n_documents"))
    return counted.orderBy(F.col("n_documents").desc(), F.col("category").asc())
