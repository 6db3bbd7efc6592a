"""Declared schemas of the ticket tables."""

from __future__ import annotations

# Table and column names with their Spark types.
SCHEMAS = {
    "ticket": (
        "id bigint, reporter string, reporter_name string, assigned_to string, "
        "assigned_to_name string, cc array<string>, created_at timestamp, status string, "
        "priority string, title string, description string, resolution string, "
        "attachment array<string>, media string"
    ),
    "labeled_ticket": "description string, assigned_to string",
    "milestone": (
        "id bigint, ticket_id bigint, datetime timestamp, description string, "
        "milestone_reporter string, milestone_reporter_name string"
    ),
    "account": (
        "id bigint, username string, name string, email string, user_type string, "
        "user_parent string, active boolean, avatar_url string, created_at timestamp, "
        "provider_id string, provider_key string"
    ),
    "token_info": "token string, email string, expires_at timestamp, account_username string",
    "password_info": "hasher string, password string, salt string, account_username string",
    "oauth1_info": "token string, secret string, account_username string",
    "oauth2_info": (
        "access_token string, token_type string, expires_in int, refresh_token string, "
        "params map<string,string>, account_username string"
    ),
    "cat": "id bigint, name array<string>, types string",
}

# The members of the enumerated column of ``cat``.
CAT_TYPES = ("Persia", "Anggora", "Garong")
