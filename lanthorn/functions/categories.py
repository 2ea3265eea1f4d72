"""The category table: what a finding is, how grave, and what replaces it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Id, label, group, severity, priority, token, pseudonym prefix.
CATEGORIES = [
    ("PERSON", "Person's name", "personal", "high", 50, "[PERSON_NAME]", "Person"),
    ("EMAIL", "Email address", "personal", "high", 92, "[EMAIL]", "Email"),
    ("PHONE", "Phone number", "personal", "high", 80, "[PHONE]", "Phone"),
    ("NATIONAL_ID", "ID or social security number", "personal", "high", 96, "[ID_NUMBER]", "IdNumber"),
    ("CREDIT_CARD", "Payment card number", "personal", "critical", 95, "[CARD_NUMBER]", "Card"),
    ("BANK_ACCOUNT", "Bank account number", "personal", "critical", 94, "[BANK_ACCOUNT]", "Account"),
    ("POSTAL_ADDRESS", "Street address", "personal", "medium", 55, "[ADDRESS]", "Address"),
    ("LOCATION", "Place name", "personal", "low", 35, "[LOCATION]", "Location"),
    ("ORGANISATION", "Company name", "personal", "medium", 48, "[COMPANY]", "Company"),
    ("INTERNAL_HOST", "Internal server name", "internal", "medium", 68, "[INTERNAL_SERVER]", "Server"),
    ("IP_ADDRESS", "IP address", "internal", "medium", 82, "[IP_ADDRESS]", "Ip"),
    ("MAC_ADDRESS", "Hardware address", "internal", "low", 81, "[MAC_ADDRESS]", "Mac"),
    ("NETWORK_PATH", "Network share or path", "internal", "medium", 70, "[NETWORK_PATH]", "Path"),
    ("URL", "Web link", "internal", "low", 60, "[URL]", "Link"),
    ("CUSTOMER_ID", "Customer number", "internal", "medium", 74, "[CUSTOMER_ID]", "Customer"),
    ("CASE_ID", "Support case number", "internal", "medium", 73, "[CASE_ID]", "Case"),
    ("CONTRACT_ID", "Contract or order number", "internal", "medium", 72, "[CONTRACT_ID]", "Contract"),
    ("EMPLOYEE_ID", "Employee number", "internal", "medium", 71, "[EMPLOYEE_ID]", "Employee"),
    ("PROJECT_CODE", "Internal project name", "confidential", "medium", 52, "[PROJECT_NAME]", "Project"),
    ("RELEASE_PLAN", "Unreleased plan or date", "confidential", "medium", 54, "[RELEASE_PLAN]", "Release"),
    ("PRICING_TERM", "Pricing or margin detail", "confidential", "medium", 56, "[PRICING]", "Pricing"),
    ("LICENSE_KEY", "Licence key", "internal", "high", 88, "[LICENCE_KEY]", "Licence"),
    ("REFERENCE_ID", "Internal reference", "internal", "low", 40, "[REFERENCE]", "Ref"),
    ("UUID", "System identifier", "internal", "low", 84, "[SYSTEM_ID]", "SystemId"),
    ("API_KEY", "API key", "secret", "critical", 100, "[REMOVED_SECRET]", "Secret"),
    ("PASSWORD", "Password", "secret", "critical", 100, "[REMOVED_SECRET]", "Secret"),
    ("ACCESS_TOKEN", "Access token", "secret", "critical", 100, "[REMOVED_SECRET]", "Secret"),
    ("PRIVATE_KEY", "Private key", "secret", "critical", 100, "[REMOVED_SECRET]", "Secret"),
    ("CONNECTION_STRING", "Database connection", "secret", "critical", 99, "[REMOVED_SECRET]", "Secret"),
]
FIELDS = ("category", "label", "group", "severity", "priority", "token", "prefix")
GROUPS = ("secret", "personal", "confidential", "internal")
SEVERITIES = ("low", "medium", "high", "critical")
SEVERITY_WEIGHT = {"critical": 45.0, "high": 18.0, "medium": 8.0, "low": 2.0}


def attribute(category: Column, field: str) -> Column:
    """A category's attribute, from a map literal: no join."""
    k = FIELDS.index(field)
    pairs = [F.lit(x) for row in CATEGORIES for x in (row[0], row[k])]
    return F.try_element_at(F.create_map(*pairs), category)


def category_table(spark: SparkSession) -> DataFrame:
    """The 29 rows as a dimension table to join with."""
    return spark.createDataFrame(CATEGORIES, "category string, label string, group string, severity string, priority int, token string, prefix string")


def sql_values() -> str:
    """The table as a VALUES list for SQL."""
    q = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(q, row)) + ")" for row in CATEGORIES)
