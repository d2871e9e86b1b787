"""What is specific to one marketplace, kept in one place so that it can be swapped."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SiteProfile:
    """Constants of the marketplace whose pages are processed."""

    base_url: str
    product_prefix: str
    url_pattern: str
    item_pattern: str
    marketplace: str
    seller_name: str
    seller_url: str
    seller_business: str
    seller_address: str
    seller_email: str
    seller_phone: str


# They appear in the output rows and error texts.
DEFAULT_SITE = SiteProfile(
    base_url="https://www.target.com",
    product_prefix="/p/",
    url_pattern=r"^https?://(www\.)?target\.com/.*",
    item_pattern=r"^\d{8,}$",
    marketplace="Target",
    seller_name="Target",
    seller_url="https://www.target.com",
    seller_business="Target Corporation",
    seller_address="1000 Nicollet Mall, Minneapolis, MN 55403",
    seller_email="",
    seller_phone="1-800-440-0680",
)
