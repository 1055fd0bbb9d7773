"""Access rules and chat prompts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Role to permissions.
ROLES = {"admin": ["read", "write", "delete", "manage"], "editor": ["read", "write"], "viewer": ["read"]}


def has_permission(users: DataFrame, permission: str) -> DataFrame:
    """users (role, is_superuser, ...) plus allowed."""
    roles = users.sparkSession.createDataFrame(list(ROLES.items()), "role string, permissions array<string>")
    j = users.join(F.broadcast(roles), "role", "left")
    return j.withColumn("allowed", F.col("is_superuser") | F.coalesce(F.array_contains("permissions", permission), F.lit(False))).drop("permissions")


def tenant(user_tenant: Column) -> Column:
    return F.coalesce(user_tenant, F.lit("default-tenant"))


def chat_prompt(messages: DataFrame) -> DataFrame:
    """conv_id, prompt: lines '[role]: text' in the order of turns."""
    line = F.concat(F.lit("["), F.coalesce("role", F.lit("")), F.lit("]: "), F.coalesce("text", F.lit("")))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"])
    return messages.groupBy("conv_id").agg(F.array_join(rows, "\n").alias("prompt"))


def has_role(role, allowed: list[str]):
    """Whether a role is among those allowed; none has no access."""
    return F.coalesce(role.isin(allowed), F.lit(False))


def generate(prompts: DataFrame, model) -> DataFrame:
    """prompts (conv_id, prompt) with answer: model(list of prompts) gives a list of texts, batch by batch."""

    def run(batches):
        for b in batches:
            yield b.assign(answer=model(list(b["prompt"])))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return prompts.mapInPandas(run, f"{fields}, answer string")


def pieces(answer: str):
    """A model without a stream of its own gives its whole answer as one piece."""
    yield answer
