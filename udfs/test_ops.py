"""Small functions for tests and examples."""


def add_bucket(row):
    return {"bucket": row["value"] // 2}


def keep_large(row):
    return row["value"] >= 2


def summarize_group(rows):
    values = [row["value"] for row in rows]
    return {"total": sum(values), "count": len(values)}


def annotate(row):
    return {"label": f"v{row['value']}"}
