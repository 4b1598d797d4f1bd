"""Functions over the test tables, with their results declared."""


def bucket_user(row):
    return {"bucket": row["user_id"] // 2}


bucket_user.returns, bucket_user.reads = "bucket bigint", ["user_id"]


def is_large(row):
    return row["value"] >= 100


is_large.reads = ["value"]


def known_user(row):
    return row["user_id"] >= 2


known_user.reads = ["user_id"]


def tag_event(row):
    return {"bucket": row["user_id"] // 2, "tags": [] if row["event_type"] == "view" else [row["event_type"], "all"]}


tag_event.returns, tag_event.reads = "bucket bigint, tags array<string>", ["user_id", "event_type"]


def two_tags(row):
    return {"tags": [] if row["event_type"] in ("error", "view") else [row["event_type"], "x"]}


two_tags.returns, two_tags.reads = "tags array<string>", ["event_type"]


def scale_user(row):
    return {"user_id": row["user_id"] * 10}


scale_user.returns, scale_user.reads = "user_id bigint", ["user_id"]


def forget_third(row):
    return {"user_id": None if row["user_id"] % 3 == 0 else row["user_id"]}


forget_third.returns, forget_third.reads = "user_id bigint", ["user_id"]


def sum_values(rows):
    return {"total": round(sum(r["value"] for r in rows), 4), "count": len(rows)}


sum_values.returns, sum_values.reads = "total double, count bigint", ["value"]


def sum_ids(rows):
    return {"total": sum(r["event_id"] for r in rows) if rows else None, "count": len(rows)}


sum_ids.returns, sum_ids.reads = "total bigint, count bigint", ["event_id"]


def never(row):
    return []


never.reads = ["event_id"]


def count_rows(rows):
    return {"count": len(rows)}


count_rows.returns, count_rows.reads = "count bigint", []
