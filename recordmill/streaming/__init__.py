"""The sync plan as Structured Streaming jobs."""

from recordmill.streaming.jobs import doorbell_stream, event_stream, sync_batch  # noqa: F401
from recordmill.streaming.log import SyncLog  # noqa: F401
