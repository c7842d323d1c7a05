"""scorecraft: evaluation of zero-shot label predictions as Spark jobs.

Every public function is a lazy ``DataFrame -> DataFrame`` transformation or a
``Column`` builder; nothing pulls data to the driver.
"""

from scorecraft.session import get_spark, checkpoint_dir, bounded_broadcast

__all__ = ["get_spark", "checkpoint_dir", "bounded_broadcast"]
