"""Column -> Column cleansing expressions; all of them stay in the JVM."""

from recordmill.functions.categories import (  # noqa: F401
    clean_deal_stage, clean_industry, clean_lifecycle, entity_of_table, stage_of_status,
)
from recordmill.functions.dates import parse_date  # noqa: F401
from recordmill.functions.events import event_fields  # noqa: F401
from recordmill.functions.numbers import (  # noqa: F401
    number_text, parse_amount, parse_integer, parse_whole,
)
from recordmill.functions.outcomes import is_retryable, outcome_class  # noqa: F401
from recordmill.functions.signatures import hmac_sha256_header, is_authentic  # noqa: F401
from recordmill.functions.text import (  # noqa: F401
    clean_phone, external_id, filled, first_link, message, normalise_domain, normalise_email,
    parse_boolean, trim_blanks,
)
