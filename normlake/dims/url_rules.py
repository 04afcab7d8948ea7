"""URL rule sets (fixed values) and the default public-suffix list."""

from __future__ import annotations

# --- fixed values ------------------------------------------------------------------------------------
TRACKING_PREFIX = "utm_"
TRACKING_NAMES = ("fbclid", "gclid", "dclid", "msclkid", "mc_cid", "mc_eid", "ref", "referrer", "source")
FUNCTIONAL_NAMES = ("page", "q", "query", "lang", "locale")
IDENTIFIER_NAMES = ("session", "sessionid", "token", "invite", "user", "account")
SHORTENER_HOSTS = ("bit.ly", "t.co", "tinyurl.com", "goo.gl", "ow.ly", "t.example")

# --- fixed values: review code -> (decision action, block) ---------------------------------------------
URL_REVIEWS = {
    "DECEPTIVE_HOST_REVIEW": ("ACCEPT_PROPOSED_CHANGE", "URL-008"),
    "ENCODED_PATH_COMPONENT_REVIEW": ("KEEP_ORIGIN_ONLY", "URL-006"),
    "FRAGMENT_SEMANTICS_REVIEW": ("REMOVE_QUERY_AND_FRAGMENT", "URL-008"),
    "FUNCTIONAL_URL_COMPONENT_REVIEW": ("KEEP_FULL_URL", "URL-006"),
    "HOST_COMPONENT_REVIEW": ("KEEP_ORIGIN_ONLY", "URL-007"),
    "IDN_CONFUSABLE_HOST_REVIEW": ("MANUAL_EDIT", "URL-003"),
    "MALFORMED_PERCENT_ENCODING_REVIEW": ("ACCEPT_PROPOSED_CHANGE", "URL-002"),
    "ORIGIN_ONLY_FUNCTIONALITY_REVIEW": ("KEEP_ORIGIN_ONLY", "URL-006"),
    "PARSE_FAILURE_REVIEW": ("ACCEPT_PROPOSED_CHANGE", "URL-002"),
    "PATH_SEMANTICS_REVIEW": ("KEEP_ORIGIN_ONLY", "URL-006"),
    "PUBLIC_SUFFIX_UNAVAILABLE_REVIEW": ("KEEP_FULL_URL", "URL-004"),
    "QR_PAYLOAD_REVIEW": ("REMOVE_QUERY_AND_FRAGMENT", "URL-001"),
    "SCHEMELESS_URL_REVIEW": ("KEEP_FULL_URL", "URL-001"),
    "UNKNOWN_URL_COMPONENT_REVIEW": ("REMOVE_QUERY_AND_FRAGMENT", "URL-005"),
    "UNRESOLVED_REDIRECT_REVIEW": ("KEEP_FULL_URL", "URL-009"),
    "URL_LINE_WRAP_RECONSTRUCTION_REVIEW": ("REMOVE_QUERY_AND_FRAGMENT", "URL-001"),
    "VISIBLE_TEXT_LINK_TARGET_REVIEW": ("ACCEPT_PROPOSED_CHANGE", "URL-001"),
}

# Suffixes known by default; pass the full published list as ``suffixes`` for production hosts. A host under
# none of them has its last label as suffix (the list's own prevailing rule).
PUBLIC_SUFFIXES = tuple(
    (
        "com net org edu gov mil int info biz io co ai app dev me tv eu de fr es it nl be ch at se no dk fi pl cz "
        "pt ie us ca au nz jp cn in br mx ru uk za kr tr ar "
        "co.uk org.uk ac.uk gov.uk co.jp ne.jp or.jp ac.jp com.au net.au org.au edu.au co.nz org.nz com.br net.br "
        "com.mx co.in net.in org.in com.cn net.cn org.cn co.za co.kr com.tr com.ar "
        "github.io gitlab.io blogspot.com appspot.com herokuapp.com netlify.app vercel.app pages.dev web.app"
    ).split()
)
