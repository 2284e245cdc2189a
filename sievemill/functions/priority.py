"""How urgent a finding is by who can reach it: P1 to P4 with the reason in words."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import cvss

# Wordings that tell what an attacker needs.
CODE_KNOWLEDGE = (
    "source code is accessible", "access to the source", "access to the repo",
    "read access to the repo", "decompil", "reverse engineer",
    "if the attacker knows", "knowing the function", "knowledge of the source",
    "internal function name", "would need to know",
    "hardcoded credential", "hardcoded password", "hardcoded secret",
    "hardcoded token", "hard-coded credential", "hard-coded password",
    "hard-coded secret", "credential in source", "secret in source",
    "test credential", "qa credential", "qa password", "test password",
    "encryption key in source", "key hardcoded",
)
INTERNAL = (
    "internal network", "intranet", "corporate network", "internal-only",
    "internal only", "back-office", "corporate sso", "enterprise sso",
    "enterprise idp", "behind sso", "behind the idp",
    "loopback", "127.0.0.1", "localhost", "local listener", "local user",
    "local access", "same host", "on the host",
    "service-to-service", "mtls", "behind api gateway", "behind the gateway",
    "vpn", "external partner", "third-party provisioned",
    "log access", "db access", "database access",
    "mitm", "man-in-the-middle", "man in the middle",
    "compromised server", "compromise of", "control of the",
    "physical access", "adjacent network",
)
HIGH_PRIVILEGE = (
    "super_admin", "super admin", "system_admin", "dist_admin",
    "with admin", "as an admin", "an admin user", "admin role",
    "privileged user", "privileged account",
    "requires admin", "admin-only", "admin privileges",
)
OBTAINABLE = (
    "self-registration", "self-registered", "self registration",
    "free signup", "sign up for", "any registered user",
    "any authenticated user", "any user account", "any valid user",
    "developer account", "portal user", "merchant account",
    "low-privilege user", "low privilege user", "lowest role",
)
NO_LOGIN = (
    "unauthenticated", "no authentication", "without authentication",
    "no auth required", "without auth", "pre-auth", "anonymous",
    "no credentials", "without credentials", "[allowanonymous]",
    "allowanonymous", "publicly accessible", "public endpoint",
)


def pattern(words: tuple[str, ...]) -> str:
    """One pattern for any of the words."""
    return "|".join(re.sub(r"([.\[\]-])", r"\\\1", w) for w in words)


def _body(title: Column, category: Column, description: Column) -> Column:
    return F.lower(F.concat_ws(" ", *[F.when(x != "", x) for x in (title, category, description)]))


def facts(body: Column, category: Column, vector: Column, external: Column) -> dict[str, Column]:
    """What the tier depends on; each word is looked up in ``body``, so those who can hold that in a column, and the facts too."""
    # one short expression a list: a hundred searches written out make a method that is too long to be compiled
    says = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(body, w))
    return {
        "code": says(CODE_KNOWLEDGE) | F.coalesce(F.lower(category).contains("hardcoded"), F.lit(False)), "says_internal": says(INTERNAL), "says_high": says(HIGH_PRIVILEGE), "obtainable": says(OBTAINABLE), "no_login": says(NO_LOGIN),
        "av": cvss.metric(vector, "AV"), "pr": cvss.metric(vector, "PR"), "ac": cvss.metric(vector, "AC"), "external": external,
    }


def tiered(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, priority, reason) of rows; ``columns`` name what :func:`tier` takes, in its order.  Texts are searched once."""
    title, category, description, vector, external = (F.col(c) for c in columns)
    known = facts(F.col("_body"), category, vector, external)
    held = rows.withColumn("_body", _body(title, category, description)).select(key, *[c.alias(f"_{k}") for k, c in known.items()])
    priority, reason = told({k: F.col(f"_{k}") for k in known})
    return held.select(key, priority.alias("priority"), reason.alias("reason"))


def tier(title: Column, category: Column, description: Column, vector: Column, external: Column) -> tuple[Column, Column]:
    """priority and reason.  ``external`` is null where no application is known; a metric that the vector lacks counts as AV:N, PR:L, AC:L."""
    return told(facts(_body(title, category, description), category, vector, external))


def told(known: dict[str, Column]) -> tuple[Column, Column]:
    """priority and reason from :func:`facts`."""
    metric = lambda name, lack: F.coalesce(F.when(known[name] != "", known[name]), F.lit(lack))
    av, pr, ac = metric("av", "N"), metric("pr", "L"), metric("ac", "L")
    explicit = F.coalesce(known["pr"] != "", F.lit(False))
    external, code = known["external"], known["code"]
    outside, inside = F.coalesce(external, F.lit(False)), F.coalesce(~external, F.lit(False))
    internal = inside | av.isin("A", "L", "P") | known["says_internal"]
    high = (pr == "H") | known["says_high"]
    free = ~(explicit & pr.isin("L", "H")) & (known["no_login"] | ((pr == "N") & ~known["obtainable"] & ~high))
    unknown = external.isNull() & (av == "N") & ~internal & ~high
    shut = ~((av == "N") & ~internal & outside) | high
    priority = F.when(code, "P4").when(unknown | shut, "P3").when(free, "P1").otherwise("P2")
    not_facing = F.lit("app not externally facing (CMDB)")
    where = F.when(inside, not_facing).when(av != "N", F.concat(F.lit("AV:"), av, F.lit(" (non-network)"))).when(internal, "internal-network position required")
    rights = F.when(high, F.when(pr == "H", "PR:H - high-privilege auth required").otherwise("admin/privileged role required"))
    effort = F.when(ac == "H", "AC:H - complex preconditions")
    facing = F.lit("internet-facing (CMDB)")
    reason = (
        F.when(code, F.concat_ws("; ", F.lit("requires source-code / insider knowledge"), F.when(inside, not_facing).when(av != "N", F.concat(F.lit("AV:"), av))))
        .when(unknown, F.concat_ws("; ", F.lit("exposure unverified — no CMDB context"), F.concat(F.lit("AV:"), av, F.lit(" (network-routable; internet exposure unconfirmed)"))))
        .when(shut, F.coalesce(F.when(where.isNotNull() | rights.isNotNull(), F.concat_ws("; ", where, rights)), F.lit("internal network / privileged position required")))
        .when(free, F.concat_ws("; ", facing, F.concat(F.lit("AV:"), av, F.lit(" - unauthenticated"), F.when(explicit, F.concat(F.lit(" (PR:"), pr, F.lit(")"))).otherwise("")), effort))
        .otherwise(F.concat_ws("; ", facing, F.concat(F.lit("PR:"), pr, F.lit(" - auth required but obtainable")), effort))
    )
    return priority, reason
