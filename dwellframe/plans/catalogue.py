"""Imports every plan module so that all queries register themselves."""

from . import q_clinical  # noqa: F401
from . import q_intake  # noqa: F401
from . import q_split  # noqa: F401
from . import q_prep  # noqa: F401
from . import q_eval  # noqa: F401
from . import q_text  # noqa: F401
from . import q_select  # noqa: F401
from . import q_models  # noqa: F401
from . import q_scores  # noqa: F401
from . import q_stream  # noqa: F401
from . import q_crf  # noqa: F401
