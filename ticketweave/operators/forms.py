"""Checks on incoming rows and the rows made from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import CAT_TYPES
from .lookup import with_expiry

# Limits of the registration form and the HTML5 e-mail pattern.
USERNAME_LENGTH = (4, 30)
EMAIL = (
    r"^[a-zA-Z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
    r"(?:\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?)*$"
)


def _blank(column: str) -> Column:
    """Null, or nothing but characters up to the space."""
    return F.coalesce(F.col(column), F.lit("")).rlike(r"^[\x00-\x20]*$")


def _with_reasons(df: DataFrame, problems: dict[str, Column]) -> DataFrame:
    reasons = F.array(*[F.when(F.coalesce(problem, F.lit(True)), F.lit(name)) for name, problem in problems.items()])
    return df.withColumn("reasons", F.array_compact(reasons))


def check_tickets(df: DataFrame) -> DataFrame:
    """Add ``reasons``: what is wrong with a submitted ticket, empty if nothing is."""
    return _with_reasons(df, {f"{c} is empty": _blank(c) for c in ("title", "description")})


def check_accounts(df: DataFrame) -> DataFrame:
    """Add ``reasons``: what is wrong with a registration, empty if nothing is."""
    low, high = USERNAME_LENGTH
    size = F.length("username")
    return _with_reasons(
        df,
        {
            "username is empty": _blank("username"),
            f"username is shorter than {low}": size < low,
            f"username is longer than {high}": size > high,
            "name is empty": _blank("name"),
            "email is not valid": ~F.col("email").rlike(EMAIL),
        },
    )


def check_cats(df: DataFrame) -> DataFrame:
    """Add ``reasons``: the enumerated column holds no other values."""
    return _with_reasons(df, {"types is not a member": ~F.col("types").isin(*CAT_TYPES)})


def accepted(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") == 0).drop("reasons")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter(F.size("reasons") > 0)


def new_tickets(forms: DataFrame, as_of: Column) -> DataFrame:
    """Ticket rows (without id) from forms with reporter, reporter_name, title, description."""
    text = F.lit(None).cast("string")
    no_list = F.array().cast("array<string>")
    return forms.select(
        "reporter",
        "reporter_name",
        text.alias("assigned_to"),
        text.alias("assigned_to_name"),
        no_list.alias("cc"),
        as_of.alias("created_at"),
        text.alias("status"),
        text.alias("priority"),
        "title",
        "description",
        text.alias("resolution"),
        no_list.alias("attachment"),
        text.alias("media"),
    )


def new_tokens(requests: DataFrame, as_of: Column, hours: int = 1) -> DataFrame:
    """Token rows for requests with email and account_username.

    The token is a digest of the request, the same on every run: an identifier
    for batch work, not a secret.
    """
    seed = F.concat_ws("|", "email", "account_username", F.date_format(as_of, "yyyy-MM-dd HH:mm:ss"))
    return with_expiry(
        requests.select(F.sha2(seed, 256).alias("token"), "email", "account_username", as_of.alias("_at")), "_at", hours
    ).select("token", "email", "expires_at", "account_username")


def explode_list(df: DataFrame, column: str, *keep: str) -> DataFrame:
    """One row per member of a list column, with its position."""
    return df.select(*keep, F.posexplode(column).alias("position", "member"))
