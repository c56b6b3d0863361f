"""Stand-ins for the model. Each is a nested function, so it travels by value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.operators.inference import Answers


def from_responses(responses: DataFrame, first_attempt: int = 0) -> Answers:
    """Answer each batch with the prepared response of the attempt asked for.

    Of responses written in the order of attempts and batches only those between the
    first and the last batch asked for are read. A run asks for several parts in one call.
    """

    def answers(prompts: DataFrame, attempt: int) -> DataFrame:
        reach = prompts.agg(F.min("batch_idx").alias("first"), F.max("batch_idx").alias("last")).first()
        prepared = responses.where(
            (F.col("attempt") == first_attempt + attempt)
            & F.col("batch_idx").between(reach["first"], reach["last"])
        )
        return prompts.select("batch_idx").join(
            prepared.select("batch_idx", "raw"), "batch_idx", "left"
        ).withColumn("error", F.lit(None).cast("string"))

    answers.together = True  # a look into a table, whichever parts of a run it is for
    return answers


def counting() -> Callable[[str], str]:
    """Answers the number of characters of the comments."""

    def transport(prompt: str) -> str:
        return str(len(prompt.split("\nComments:\n", 1)[1]))

    return transport


def only(answers: Answers, wanted: Callable[[Column], Column]) -> Answers:
    """Pass on the answers of some batches, picked by their number; the others get none."""

    def some(prompts: DataFrame, attempt: int) -> DataFrame:
        mine = wanted(F.col("batch_idx"))
        return answers(prompts, attempt).withColumn("raw", F.when(mine, F.col("raw")))

    return some


def counting_analyst() -> Callable[[str], str]:
    """Answers every comment, whatever its id, with the length of its text."""

    def transport(prompt: str) -> str:
        import json
        import re

        comments = prompt.split("\nComments:\n", 1)[1]
        cells = re.split(r"(?m)^\[(jsonl_\d+)\] ", comments)[1:]
        return json.dumps({"analyses": [
            {"verbatim_id": vid, "theme": "theme", "sentiment": "neutre",
             "summary": f"{len(text.removesuffix(chr(10)))} characters"}
            for vid, text in zip(cells[::2], cells[1::2])
        ]})

    return transport


def echo_analyst() -> Callable[[str], str]:
    """Answers every comment from its own text and id, without faults."""

    def transport(prompt: str) -> str:
        import hashlib
        import json
        import re

        def summary(text: str) -> str:
            plain = re.sub(r"[ \t\n\r]+", " ", text.removesuffix("\n"))
            if len(plain) <= 60:
                return plain
            return f"{plain[:60]} {len(plain)} {hashlib.md5(plain.encode()).hexdigest()}"

        comments = prompt.split("\nComments:\n", 1)[1]
        cells = re.split(r"(?m)^\[(doc_\d+)\] ", comments)[1:]
        out = []
        for vid, text in zip(cells[::2], cells[1::2]):
            n = int(vid[4:])
            out.append({
                "verbatim_id": vid,
                "theme": f"theme {n % 23}",
                "summary": summary(text),
                "sentiment": ["positif", "négatif", "neutre"][n % 3],
            })
        return json.dumps({"analyses": out}, ensure_ascii=False)

    return transport


def killing(transport: Callable[[str], str | None], share: int = 20) -> Callable[[str], str | None]:
    """Kills the task that asks one of about every `share` prompts."""

    def deadly(prompt: str) -> str | None:
        import zlib

        if zlib.crc32(prompt.encode()) % share == 0:
            raise type("Killed", (BaseException,), {})("killed")
        return transport(prompt)

    return deadly


def echo_harmonizer(categories: list[str]) -> Callable[[str], str]:
    """Maps `theme <lang> <n>` by n and leaves some themes out; other names stay as they are."""

    def transport(prompt: str) -> str:
        import json

        mapping = {}
        for line in prompt.split("\nThemes:\n", 1)[1].splitlines():
            theme = line.removeprefix("- ")
            number = theme.split(" ")[-1]
            if not number.isdigit():
                mapping[theme] = theme
                continue
            n = int(number)
            macro = "Hors liste" if n == 22 else ["Produit", "Service", "Tarifs", None][n % 4]
            if macro is not None:
                mapping[theme] = macro
        return json.dumps({"categories": categories, "mapping": mapping}, ensure_ascii=False)

    return transport


def echo_synthesizer(refuse: str) -> Callable[[str], str]:
    """First two positive and negative lines, and how many lines were read in all.

    A partial synthesis tells its count in its last words, so the counts of a merged
    one add up and a lost chunk shows. Refuses one category.
    """

    def transport(prompt: str) -> str:
        import json

        subject, lines = prompt.split("\nSubject: ", 1)[1].split("\n\n", 1)
        if subject == refuse:
            return "Je ne peux pas répondre."
        rows = lines.splitlines()
        parts = [r for r in rows if r.startswith("- [bilan] ")]
        n = sum(int(r.rsplit(" ", 1)[1]) for r in parts) if parts else len(rows)

        def first_two(mark: str) -> list[str]:
            return [r.removeprefix(mark) for r in rows if r.startswith(mark)][:2]

        return json.dumps({
            "macro_theme": subject,
            "positive_points": first_two("- [positif] "),
            "negative_points": first_two("- [négatif] "),
            "global_synthesis": f"{subject}: bilan {n}",
        }, ensure_ascii=False)

    return transport
