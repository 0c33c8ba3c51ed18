"""Column expressions shared by the operators (all built-in Spark functions)."""

from shelfwise.functions.expressions import (  # noqa: F401
    as_of_literal,
    delivery_fee,
    file_extension,
    first_element,
    is_sale,
    line_text,
    money,
    month_label,
    name_token,
    search_match,
    since,
    since_month,
    split_list,
    window_start,
    status_is,
)
