from tallyspark.functions.jsonx import has_key, jbool, jdec, jint, jlong, jstr, jts  # noqa: F401
from tallyspark.functions.pgcompat import (  # noqa: F401
    epoch_seconds, org_repo, pg_concat, revert_title, utc_date,
)
